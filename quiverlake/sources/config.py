"""Settings files of ``key: value`` and ``key: [a, b]`` lines, and the settings of a benchmark run read from them."""

from __future__ import annotations

from dataclasses import dataclass

from ..operators.index import Attributes, clustering


def read_config(text: str) -> dict[str, str | list[str]]:
    """Values as text; white space is left out, blank lines and lines from # on are skipped."""
    out: dict[str, str | list[str]] = {}
    for n, line in enumerate(text.splitlines(), 1):
        line = "".join(line.split())
        if not line or line.startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon or not key or not value:
            raise ValueError(f"line {n}: key:value expected")
        out[key] = [x for x in value[1:-1].split(",") if x] if value[0] == "[" and value[-1] == "]" else value
    return out


def unsigned(value: str, low: int = 0, high: int = 2**64 - 1) -> int:
    if not value.isdigit() or not low <= int(value) <= high:
        raise ValueError(f"a whole number from {low} to {high} expected: {value}")
    return int(value)


def boolean(value: str) -> bool:
    if value.lower() not in ("true", "false", "1", "0"):
        raise ValueError(f"true or false expected: {value}")
    return value.lower() in ("true", "1")


#: Whole numbers: key, least, largest (None: no limit of its own). All are required. Fixed names.
NUMBERS = {
    "leaf-split": (2, None),
    "internal-split": (2, None),
    "default-leaf-search-span": (1, None),
    "default-internal-search-span": (1, None),
    "default-k": (1, None),
    "random-rate-base": (0, None),
    "migration-check-trigger-rate": (0, None),
    "migration-check-trigger-single-rate": (0, None),
    "num-client-threads": (1, None),
    "num-searcher-threads": (0, None),
    "num-bg-migrator-threads": (0, None),
    "num-bg-merger-threads": (0, None),
    "num-bg-compactor-threads": (0, None),
    "write-ratio": (0, 100),
    "delete-ratio": (0, 100),
    "bench-batch-size": (1, None),
    "build-size": (0, None),
    "warmup-time": (0, None),
    "run-time": (0, None),
}
FLAGS = ("use-block-bytes", "collect-build-stats", "collect-warmup-stats", "collect-run-stats", "collect-avg-distances")


@dataclass(frozen=True)
class Settings:
    attributes: Attributes
    clustering: str
    numbers: dict[str, int]
    flags: dict[str, bool]
    log_path: str | None

    def __getitem__(self, key: str) -> int | bool:
        return self.numbers[key] if key in self.numbers else self.flags[key]


def parse_settings(found: dict[str, str | list[str]], dimension: int, metric: str = "l2_int", element_bytes: int = 1) -> Settings:
    """Settings of a run from a file's values; ValueError names the first key that is missing or out of its limits."""

    def one(key: str, kind: type = str):
        if key not in found:
            raise ValueError(f"{key}: missing")
        if not isinstance(found[key], kind):
            raise ValueError(f"{key}: {'a list' if kind is list else 'one value'} expected")
        return found[key]

    def number(key: str, low: int = 0, high: int | None = None) -> int:
        try:
            return unsigned(one(key), low, 2**64 - 1 if high is None else high)
        except ValueError as e:
            raise ValueError(f"{key}: {e}") from None

    def flag(key: str) -> bool:
        try:
            return boolean(one(key))
        except ValueError as e:
            raise ValueError(f"{key}: {e}") from None

    def sizes(key: str) -> tuple[int, int]:
        both = one(key, list)
        if len(both) != 2:
            raise ValueError(f"{key}: two sizes expected")
        low, high = (unsigned(x) for x in both)
        if high // 2 <= low:
            raise ValueError(f"{key}: the largest must be more than twice the least")
        return low, high

    clustering(one("clustering"))
    (leaf_min, leaf_max), (internal_min, internal_max) = sizes("leaf-size"), sizes("internal-size")
    numbers = {k: number(k, *limits) for k, limits in NUMBERS.items()}
    flags = {k: flag(k) for k in FLAGS}
    unit = "bytes" if flags["use-block-bytes"] else "size"
    for level in ("leaf", "internal"):
        numbers[f"{level}-block-{unit}"] = number(f"{level}-block-{unit}", dimension * element_bytes)
    for key in ("migration-check-trigger-rate", "migration-check-trigger-single-rate"):
        if numbers[key] > numbers["random-rate-base"]:
            raise ValueError(f"{key}: more than random-rate-base")
    numbers["throughput-report-time"] = number("throughput-report-time") if "throughput-report-time" in found else 0
    if numbers["throughput-report-time"]:
        flags["show-runtime-report-for-build-and-warmup"] = flag("show-runtime-report-for-build-and-warmup")
    attributes = Attributes(dimension, metric, leaf_min, leaf_max, internal_min, internal_max, numbers["leaf-split"])
    log = found.get("log-path")
    return Settings(attributes, one("clustering"), numbers, flags, log if isinstance(log, str) else None)
