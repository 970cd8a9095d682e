"""Options of the operators, checked when a query is built."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class OutputFormat(Enum):
    WKT = "WKT"
    WKB = "WKB"
    GEOJSON = "GEOJSON"


class Algorithm(Enum):
    DOUGLAS_PEUCKER = "DOUGLAS_PEUCKER"
    TOPOLOGY_PRESERVING = "TOPOLOGY_PRESERVING"


def _member(kind: type[Enum], value) -> Enum:
    if isinstance(value, kind):
        return value
    try:
        return kind[str(value).upper()]
    except KeyError:
        raise ValueError(f"{kind.__name__}: {value!r}, not one of {[m.name for m in kind]}") from None


def output_format(value: str | OutputFormat) -> OutputFormat:
    """Of any letter case."""
    return _member(OutputFormat, value)


def algorithm(value: str | Algorithm) -> Algorithm:
    """Of any letter case."""
    return _member(Algorithm, value)


def zoom_level(value: int) -> int:
    """A non-negative integer; there is no upper limit."""
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"zoom must be an integer, not {value!r}")
    if value < 0:
        raise ValueError("zoom must not be negative")
    return value


@dataclass(frozen=True)
class Simplify:
    """How to simplify; both members are needed, else shapes stay as they are."""

    zoom: int
    algorithm: Algorithm

    @staticmethod
    def parse(value) -> Simplify | None:
        """From None, a Simplify, a mapping, or a list whose first entry counts.

        Of a mapping only an integer ``zoom`` and a string ``algorithm`` are read; without both,
        nothing is simplified. A zoom of -1 means none.
        """
        if isinstance(value, (list, tuple)):
            value = value[0] if value else None
        if value is None or isinstance(value, Simplify):
            return value
        zoom, name = value.get("zoom"), value.get("algorithm")
        if not isinstance(zoom, int) or isinstance(zoom, bool) or zoom == -1 or not isinstance(name, str):
            return None
        return Simplify(zoom_level(zoom), algorithm(name))


@dataclass(frozen=True)
class ScriptParams:
    """Parameters of the per-row simplification, as a mapping gives them."""

    field: str
    zoom: int
    algorithm: Algorithm = Algorithm.DOUGLAS_PEUCKER
    output_format: OutputFormat = OutputFormat.GEOJSON

    @staticmethod
    def parse(params: dict) -> ScriptParams:
        if not params:
            raise ValueError("parameters are missing")
        for name in ("field", "zoom"):
            if params.get(name) is None:
                raise ValueError(f"parameter {name} is missing")
        return ScriptParams(
            params["field"],
            zoom_level(params["zoom"]),
            algorithm(params.get("algorithm", "DOUGLAS_PEUCKER")),
            output_format(params.get("output_format", "GEOJSON")),
        )


@dataclass(frozen=True)
class ShapeAggRequest:
    """Parameters of the aggregation by shape, checked and with their defaults."""

    field: str
    output_format: OutputFormat = OutputFormat.GEOJSON
    simplify: Simplify | None = None
    size: int = 10
    shard_size: int = -1
    #: WKB that stands for shapes that are not there.
    missing: bytes | None = None

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError(f"size must be over 0, not {self.size}")
        if self.shard_size <= 0 and self.shard_size != -1:
            raise ValueError(f"shard_size must be over 0, not {self.shard_size}")

    @property
    def cut(self) -> int:
        """Shapes that survive the first ranking."""
        return max(self.size, self.shard_size)

    @staticmethod
    def parse(body: dict) -> ShapeAggRequest:
        if unknown := set(body) - {"field", "output_format", "simplify", "size", "shard_size", "missing"}:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        if not body.get("field"):
            raise ValueError("parameter field is missing")
        if "shard_size" in body and body["shard_size"] <= 0:
            raise ValueError(f"shard_size must be over 0, not {body['shard_size']}")
        missing = body.get("missing")  # bytes, or their hexadecimal digits
        return ShapeAggRequest(
            body["field"],
            output_format(body.get("output_format", "GEOJSON")),
            Simplify.parse(body.get("simplify")),
            body.get("size", 10),
            body.get("shard_size", -1),
            bytes.fromhex(missing) if isinstance(missing, str) else missing,
        )
