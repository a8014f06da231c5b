"""Scoring configuration and the content hashes that name its results."""

from __future__ import annotations

import hashlib
import json
import math
import platform
from dataclasses import asdict, dataclass, field
from importlib import metadata
from pathlib import Path
from urllib.parse import parse_qsl, unquote, urlencode, urlsplit

#: Categories in their order, with the count that earns full points.
CAPS = {"shops": 5, "transport": 5, "healthcare": 3, "parks": 2}
CATEGORIES = tuple(CAPS)
#: Tag rules, in the order in which they are tried; None is any value.
TAG_RULES = [
    ("shops", "shop", None),
    ("transport", "highway", ["bus_stop"]),
    ("transport", "railway", ["station", "tram_stop", "halt"]),
    ("healthcare", "amenity", ["pharmacy", "hospital", "clinic", "doctors", "dentist", "health_centre"]),
    ("parks", "leisure", ["park", "playground", "nature_reserve", "garden"]),
]
#: Ways that nobody walks, and access values that forbid walking.
EXCLUDED_HIGHWAYS = ["construction", "motor", "motorway", "motorway_link", "planned", "proposed", "raceway", "trunk", "trunk_link"]
FORBIDDEN_ACCESS = ["private", "no"]
#: Grid sizes in metres, the zoom from which each is drawn, colours by score and by category.
GRID_SIZES_M = [20000, 10000, 5000]
ZOOM_BREAKS = [(11, 5000), (8, 10000), (0, 20000)]
SCORE_COLORS = [(0, "#440154"), (25, "#3b528b"), (50, "#21908c"), (75, "#5dc863"), (100, "#fde725")]
CATEGORY_COLORS = {"shops": "#2166ac", "transport": "#762a83", "healthcare": "#d6604d", "parks": "#1a9850"}
OTHER_COLOR = "#888888"
#: Tile zooms and box (west, south, east, north), tile units and margin, and the earth's radius in metres.
TILE_ZOOMS, AMENITY_ZOOM, TILE_BOX = (5, 14), 9, (-11.0, 51.3, -5.3, 55.5)
TILE_EXTENT, TILE_BUFFER = 4096, 64
EARTH_RADIUS_M = 6_371_000.0
POINTS = 25.0


@dataclass(frozen=True)
class ScoringConfig:
    """What a build depends on.  A change of a field moves the hashes from its tier on."""

    study_area: str = "ireland"
    boundary: tuple = ()
    walk_radius_m: float = 500.0
    caps: dict = field(default_factory=lambda: dict(CAPS))
    grid_sizes_m: tuple = tuple(GRID_SIZES_M)
    zoom_breaks: tuple = tuple(ZOOM_BREAKS)
    colors: dict = field(default_factory=lambda: dict(CATEGORY_COLORS))
    graph_version: int = 3
    grid_version: int = 2
    tile_version: int = 2
    cache_version: int = 7


def hash_of(payload: dict) -> str:
    """The first 12 hex digits of the SHA-256 of a payload's sorted-key JSON."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, default=str).encode()).hexdigest()[:12]


#: Digits of a content hash, and what stands for a file that can't be read.
CONTENT_DIGITS, UNREADABLE = 16, "missing"


def content_hash(path: str | Path) -> str:
    """The first digits of a file's SHA-256."""
    try:
        with open(path, "rb") as f:
            return hashlib.file_digest(f, "sha256").hexdigest()[:CONTENT_DIGITS]
    except OSError:
        return UNREADABLE


#: Fields of each tier; a tier's hash also covers the tier before it.
TIERS = {
    "geo": ("study_area", "boundary", "walk_radius_m", "graph_version", "cache_version"),
    "reach": ("walk_radius_m",),
    "score": ("caps", "grid_sizes_m", "grid_version"),
    "render": ("zoom_breaks", "colors", "tile_version"),
}


def tier_hashes(config: ScoringConfig, import_fingerprint: str | None = None) -> dict[str, str]:
    """Hashes of geo, reach, score and render, each over its own fields and its predecessor; ``config`` and, for an import, ``build``.  The order of grid sizes and of zoom breaks moves no hash."""
    values, found, before = asdict(config), {}, import_fingerprint
    values |= {n: sorted(values[n]) for n in ("grid_sizes_m", "zoom_breaks")}
    for tier, names in TIERS.items():
        own = {n: values[n] for n in names} | ({"tags": TAG_RULES} if tier == "reach" else {})
        before = found[tier] = hash_of({"tier": tier, "before": before, **own})
    plain = found if import_fingerprint is None else tier_hashes(config)
    found["config"] = plain["config"] if import_fingerprint else hash_of({"score": found["score"], "render": found["render"], "cache_version": config.cache_version})
    if import_fingerprint:
        found["build"] = hash_of({"import_fingerprint": import_fingerprint, "config": found["config"]})
    return found


def check_extract_name(path: str) -> None:
    """Raises where a name, in letters of either case, doesn't end in ``.osm.pbf``."""
    if path.lower().endswith(".pdf"):
        raise ValueError(f"{path} ends with .pdf; .osm.pbf is meant")
    if not path.lower().endswith(".osm.pbf"):
        raise ValueError(f"{path} is no .osm.pbf file")


def check_extract(path: str) -> Path:
    """An extract's path on this machine; raises where it isn't an existing ``.osm.pbf`` file."""
    check_extract_name(path)
    if not Path(path).is_file():
        raise FileNotFoundError(path)
    return Path(path)


def extract_fingerprint(path: str) -> str:
    found = check_extract(path)
    stat = found.stat()
    return hash_of({"path": str(found.resolve()), "size": stat.st_size, "mtime_ns": stat.st_mtime_ns, "content": content_hash(found)})


def import_fingerprint(extract: str, importer_version: str, rules: dict | None = None) -> str:
    return hash_of({"extract": extract, "importer_version": importer_version, "rules": rules or TAG_RULES})


#: The packages whose versions a snapshot holds: those that results depend on.
PACKAGES = ("pyspark", "py4j", "pyarrow", "pandas", "numpy", "duckdb", "tokenizers", "xxhash", "regex", "zstandard")


def environment(packages: tuple[str, ...] = PACKAGES) -> dict[str, str]:
    """The Python version and those of packages, ``unknown`` for one that is missing."""
    found = {"python": platform.python_version()}
    for name in packages:
        try:
            found[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            found[name] = "unknown"
    return found


#: Names of the settings of a database, and hosts that need no password.
DATABASE_SETTINGS = ("DATABASE_URL", "POSTGRES_HOST", "POSTGRES_PORT", "POSTGRES_DB", "POSTGRES_USER", "POSTGRES_PASSWORD")
LOCAL_HOSTS = ("localhost", "127.0.0.1", "::1")


def jdbc_options(settings: dict[str, str]) -> dict[str, str]:
    """Options of Spark's JDBC source from a URL (``postgres://`` and ``postgresql://``, also with a driver's name) or single settings; a query's ``ssl`` entries go on as they are.

    Raises where settings are missing, and where a host that isn't local has no password.
    """
    if url := settings.get("DATABASE_URL"):
        parts = urlsplit(url)
        if parts.scheme.split("+")[0] not in ("postgres", "postgresql"):
            raise ValueError(f"{parts.scheme} is no PostgreSQL address")
        host, port, name = parts.hostname, parts.port or 5432, parts.path.lstrip("/")
        user, password, more = unquote(parts.username or ""), unquote(parts.password or ""), parts.query
    else:
        if missing := [n for n in DATABASE_SETTINGS[1:] if n != "POSTGRES_PORT" and not settings.get(n)]:
            raise RuntimeError(f"no database: set {DATABASE_SETTINGS[0]} or {', '.join(missing)}")
        host, name, user, password = (settings[n] for n in ("POSTGRES_HOST", "POSTGRES_DB", "POSTGRES_USER", "POSTGRES_PASSWORD"))
        port, more = settings.get("POSTGRES_PORT") or 5432, ""
    if not host or not name:
        raise ValueError("a database address has a host and a name")
    if not password and host not in LOCAL_HOSTS:
        raise ValueError(f"{host} needs a password")
    ssl = {k: v for k, v in parse_qsl(more) if k.startswith("ssl")}
    query = f"?{urlencode(ssl)}" if ssl else ""
    shown = f"[{host}]" if ":" in host else host
    return {"url": f"jdbc:postgresql://{shown}:{port}/{name}{query}", "driver": "org.postgresql.Driver"} | {k: v for k, v in (("user", user), ("password", password)) if v}


def quoted(identifier: str) -> str:
    """An identifier for Spark SQL."""
    return f"`{identifier.replace('`', '``')}`"


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``minlat,minlon,maxlat,maxlon`` with blanks allowed; raises ValueError else."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError(f"a box has four numbers: {text!r}")
    south, west, north, east = map(float, parts)
    if not (south <= north and west <= east):
        raise ValueError(f"a box's minima come first: {text!r}")
    return south, west, north, east


def expand_bbox(box: tuple[float, float, float, float], metres: float) -> tuple[float, float, float, float]:
    """The box widened on all sides, by 111,320 m a degree; nothing for a padding of 0 or less."""
    if metres <= 0:
        return box
    south, west, north, east = box
    lat = metres / 111_320.0
    lon = lat / max(0.01, math.cos(math.radians((south + north) / 2)))
    return south - lat, west - lon, north + lat, east + lon


def same_box(a: tuple | None, b: tuple | None, tolerance: float = 1e-9) -> bool:
    """Boxes rounded to 8 places agree."""
    if a is None or b is None:
        return a is b
    return all(abs(round(x, 8) - round(y, 8)) <= tolerance for x, y in zip(a, b, strict=True))


def hms(seconds: float) -> str:
    whole = max(0, int(seconds))
    return f"{whole // 3600:02d}:{whole % 3600 // 60:02d}:{whole % 60:02d}"
