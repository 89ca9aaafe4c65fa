"""Requests: the parameters that select and process data, their defaults and checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from terrane.operators.filters import levels
from terrane.sources.readers import region

#: Members of the enumerations that requests use.
CONFIDENCE = {"tep": -2, "not_considered": -1, "background": 0, "within_10m": 1, "low": 2, "medium": 3, "high": 4}
SURFACES = {"dynamic": -1, "land": 0, "ocean": 1, "sea_ice": 2, "land_ice": 3, "inland_water": 4}
QUALITY = {"nominal": 0, "possible_afterpulse": 1, "possible_impulse_response": 2, "possible_tep": 3}
CLASSES = {"noise": 0, "ground": 1, "canopy": 2, "top_of_canopy": 3, "unclassified": 4}
WATER_CLASSES = {"unclassified": 0, "bathymetry": 40, "sea_surface": 41}
BEAMS = {"gt1l": 10, "gt1r": 20, "gt2l": 30, "gt2r": 40, "gt3l": 50, "gt3r": 60}
FOOTPRINT_BEAMS = (0, 1, 2, 3, 5, 6, 8, 11)
#: Accepted and without effect here: the cluster manages time-outs, nodes and credentials itself.
IGNORED = {"timeout", "rqst_timeout", "node_timeout", "read_timeout", "cluster_size_hint", "key_space", "asset", "resource"}
#: Options that no plan carries out; each is an error unless it has the value that changes nothing.
UNSUPPORTED = {"points_in_polygon": 0, "datum": "ITRF2014", "proj": "auto"}


def member(value: str | int, table: dict[str, int], prefix: str = "") -> int:
    """The number of a member given by number or name; names may carry a prefix."""
    if isinstance(value, int):
        if value not in table.values():
            raise ValueError(f"{value} is not one of {sorted(table.values())}")
        return value
    name = value.lower().removeprefix(prefix)
    if name not in table:
        raise ValueError(f"{value!r} is not one of {sorted(table)}")
    return table[name]


def members(value: Any, table: dict[str, int], prefix: str = "") -> list[int]:
    """One value means that level and all higher ones; a list means its members."""
    if isinstance(value, list | tuple | set):
        return sorted({member(v, table, prefix) for v in value})
    return levels(member(value, table, prefix), table.values())


@dataclass
class Request:
    poly: list | None = None
    region_mask: dict | None = None
    cellsize: float = 0.01
    t0: str | None = None
    t1: str | None = None
    resources: list[str] | None = None
    max_resources: int = 300
    beams: list[int] = field(default_factory=lambda: sorted(BEAMS.values()))
    spots: list[int] = field(default_factory=lambda: [1, 2, 3, 4, 5, 6])
    cnf: list[int] = field(default_factory=lambda: [2, 3, 4])
    srt: int = -1
    quality_ph: list[int] = field(default_factory=lambda: [0])
    atl08_class: list[int] | None = None
    podppd: int = 0
    len: float = 40.0
    res: float = 20.0
    cnt: int = 10
    ats: float = 20.0
    pass_invalid: bool = False
    fit: dict | None = None
    phoreal: dict | None = None
    yapc: dict | None = None
    als: dict | None = None
    atl24: dict | None = None
    atl13: dict | None = None
    te_quality_filter: int | None = None
    can_quality_filter: int | None = None
    degrade_filter: bool = False
    l2_quality_filter: bool = False
    l4_quality_filter: bool = False
    surface_filter: bool = False
    ph_in_extent: int = 8192
    surface: dict | None = None
    refraction: dict | None = None
    max_dem_delta: float = 50.0
    min_dem_delta: float = -100.0
    max_geoid_delta: float = 50.0
    min_geoid_delta: float = -100.0
    anc_fields: list[str] = field(default_factory=list)
    samples: dict | None = None
    subsetting: str = "contiguous"
    output: dict | None = None

    @classmethod
    def parse(cls, parms: dict) -> Request:
        known = {f.name for f in fields(cls)}
        for k, v in UNSUPPORTED.items():
            if parms.get(k, v) != v:
                raise ValueError(f"{k} = {parms[k]!r} is not supported")
        given = {k: v for k, v in parms.items() if k not in IGNORED and k not in UNSUPPORTED}
        if "resource" in parms and "resources" not in given:
            given["resources"] = [parms["resource"]]
        if "track" in given:  # overrides beams; 0 means all
            track = given.pop("track")
            given["beams"] = sorted(BEAMS.values()) if track == 0 else [track * 20 - 10, track * 20]
        anc = [v for k in list(given) if k.endswith("_fields") and k not in known for v in given.pop(k)]
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        r = cls(**given)
        r.anc_fields = [*r.anc_fields, *anc]
        if r.poly is not None:
            r.poly = region(r.poly)
        if "cnf" in given:
            r.cnf = members(given["cnf"], CONFIDENCE, "atl03_")
        if "quality_ph" in given:
            r.quality_ph = members(given["quality_ph"] if isinstance(given["quality_ph"], list) else [given["quality_ph"]], QUALITY, "atl03_quality_")
        if r.atl08_class is not None:
            r.atl08_class = members(list(r.atl08_class), CLASSES, "atl08_")
        if "srt" in given:
            r.srt = member(given["srt"], SURFACES, "srt_")
        if "beams" in given:
            r.beams = [member(b, BEAMS) for b in r.beams]
        if r.len <= 0 or r.res <= 0:
            raise ValueError("len and res must be positive")
        if r.ph_in_extent < 1:
            raise ValueError("ph_in_extent must be positive")
        if r.resources is not None and len(r.resources) > r.max_resources:
            raise ValueError(f"more than {r.max_resources} resources")
        return r


def defaults() -> dict:
    """All parameters with their defaults."""
    return {f.name: getattr(Request(), f.name) for f in fields(Request)}
