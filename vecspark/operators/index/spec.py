"""What an index is made of and may be asked: one validated record for all index types."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from ...errors import EmptyParameter, FailedToCreateIndex, InvalidDimension, InvalidParameter, UnsupportedIndexType
from ...functions.distance import Space

TYPES = ("flat", "ivf_flat", "ivfpq", "hnsw")
DEFAULTS: dict[str, dict[str, int]] = {
    "flat": {},
    "ivf_flat": {"nlist": 100, "nprobe": 10},
    "ivfpq": {"nlist": 100, "nprobe": 10, "m": 8, "nbits": 8},
    "hnsw": {"M": 16, "efConstruction": 200, "maxElements": 100_000, "efsearch": 10},
}
#: Parameters that may change after an index is made.
QUERY_TIME = {"flat": None, "ivf_flat": "nprobe", "ivfpq": "nprobe", "hnsw": "efsearch"}


def _whole(key: str, value) -> int:
    try:
        if isinstance(value, bool) or int(float(value)) != float(value):
            raise ValueError
    except (TypeError, ValueError):
        raise InvalidParameter(f"{key} = {value!r}") from None
    return int(float(value))


@dataclass(frozen=True)
class IndexSpec:
    dimension: int
    index_type: str = "hnsw"
    space: str = "l2"
    parameters: dict = field(default_factory=dict)

    @classmethod
    def of(cls, dimension: int, index_type: str = "hnsw", space: str = "l2", **parameters) -> IndexSpec:
        if not isinstance(dimension, int) or dimension <= 0:
            raise InvalidDimension(str(dimension))
        if index_type not in TYPES:
            raise UnsupportedIndexType(str(index_type))
        if space not in [s.value for s in Space]:
            raise InvalidParameter(f"space = {space!r}")
        if index_type == "ivfpq" and space != "l2":
            raise FailedToCreateIndex("product quantization scores squared L2 only")
        if index_type == "hnsw" and space not in ("l2", "ip"):
            raise FailedToCreateIndex("a graph index takes l2 or ip")
        p = dict(DEFAULTS[index_type])
        for key, value in parameters.items():
            if key not in p:
                raise InvalidParameter(f"{key} for {index_type}")
            p[key] = _whole(key, value)
        if "nlist" in p:
            if p["nlist"] < 1:
                raise InvalidParameter(f"nlist = {p['nlist']}")
            p["nprobe"] = min(max(p["nprobe"], 1), p["nlist"])
        if "m" in p:
            p["m"] = max(p["m"], 1)
            if dimension % p["m"]:
                raise InvalidDimension(f"{dimension} is not divisible by m = {p['m']}")
            if p["nbits"] != 8:
                raise InvalidParameter("nbits must be 8")
        if "M" in p:
            if min(p["M"], p["maxElements"]) < 1:
                raise InvalidParameter(f"M = {p['M']}, maxElements = {p['maxElements']}")
            p["efConstruction"] = max(p["efConstruction"], p["M"])
        return cls(dimension, index_type, space, p)

    def with_params(self, **changes) -> IndexSpec:
        """A copy with query-time parameters changed; others cannot be."""
        if self.index_type == "flat":
            return self
        if not changes:
            raise EmptyParameter()
        p = dict(self.parameters)
        for key, value in changes.items():
            if key != QUERY_TIME[self.index_type]:
                raise InvalidParameter(f"{key} for {self.index_type}")
            n = _whole(key, value)
            if key == "nprobe" and not 1 <= n <= p["nlist"] or n < 1:
                raise InvalidParameter(f"{key} = {n}")
            p[key] = n
        return replace(self, parameters=p)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> IndexSpec:
        return cls(**json.loads(text))
