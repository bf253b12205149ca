"""Check selection, organisation config and the extension registry: driver-side configuration."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The checks, whether they are on by default, and their groups.
CHECKS: dict[str, tuple[bool, tuple[str, ...]]] = {
    "adl-visibility": (True, ()),
    "ctad-visibility": (True, ()),
    "specialization-visibility": (True, ()),
    "default-arg-divergence": (True, ()),
    "static-init-order": (True, ()),
    "static-init-hazards": (False, ("compute-heavy",)),
    "header-static-duplication": (True, ()),
    "exception-spec-divergence": (True, ()),
    "exception-escape": (False, ("noisy",)),
    "odr-violations": (False, ("compute-heavy",)),
    "coverage-properties": (False, ("noisy",)),
    "dead-code": (False, ("compute-heavy",)),
}
CONFIG_NAME = "checks.json"


@dataclass
class Registry:
    """What an organisation adds; a value, not a global."""

    lock_types: list[str] = field(default_factory=list)
    channel_types: list[dict] = field(default_factory=list)
    flag_patterns: list[tuple[str, int]] = field(default_factory=list)
    collapse_paths: list[str] = field(default_factory=list)
    hazards: list[str] = field(default_factory=list)
    disabled: list[str] = field(default_factory=list)
    index_checks: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)
    unit_checks: dict[str, Callable[[DataFrame, dict[str, DataFrame]], DataFrame]] = field(default_factory=dict)
    guard_classifiers: list[Callable[[Column], Column]] = field(default_factory=list)
    groups: dict[str, list[str]] = field(default_factory=dict)

    def add(self, name: str, *values) -> None:
        """Add values to one of the lists, each once, in order."""
        known = getattr(self, name)
        known.extend(v for v in values if v not in known)

    def enabled(self) -> dict[str, Callable[[dict[str, DataFrame]], DataFrame]]:
        return {k: v for k, v in self.index_checks.items() if k not in self.disabled}

    def run(self, tables: dict[str, DataFrame]) -> DataFrame | None:
        """Diagnostics of the organisation's own checks over the whole index."""
        out = None
        for check in self.enabled().values():
            out = check(tables) if out is None else out.unionByName(check(tables))
        return out

    def run_units(self, unit_facts: DataFrame, tables: dict[str, DataFrame]) -> DataFrame | None:
        """Diagnostics of its checks over facts of units: each gets rows that name their unit, and the index."""
        out = None
        for name, check in self.unit_checks.items():
            if name not in self.disabled:
                found = check(unit_facts, tables)
                out = found if out is None else out.unionByName(found)
        return out

    def classify_guards(self, guards: DataFrame, column: str = "condition_text") -> DataFrame:
        """Adds ``guard_kind``, a struct (kind, name): of the first classifier that knows the condition, or null."""
        none = F.lit(None).cast("struct<kind:string,name:string>")
        return guards.withColumn("guard_kind", F.coalesce(*[c(F.col(column)) for c in self.guard_classifiers], none))


def run_workers(units: DataFrame, worker: Callable[[list[str]], list[dict]], schema: str, batch: int = 64) -> DataFrame:
    """Facts that ``worker`` gives for batches of units (tu_path), where they are: the seam for a parser.

    A worker gets paths and gives rows of ``schema``; a task that is lost is run again.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(units.sparkSession.createDataFrame([], schema).schema)

    def run(batches):
        for part in batches:
            paths = part.column(0).to_pylist()
            for at in range(0, len(paths), batch):
                yield pa.RecordBatch.from_pylist(worker(paths[at : at + batch]), schema=arrow)

    return units.select("tu_path").mapInArrow(run, schema)


def resolve_checks(spec: str | list[str] = "", registry: Registry | None = None) -> set[str]:
    """Checks that an ordered list of entries leaves on, from the defaults.

    ``name`` or ``group`` adds, ``-name`` or ``-group`` removes, ``all`` is every check.
    Unknown entries are ``ValueError``.
    """
    own = (registry or Registry()).enabled()
    on = {k for k, (default, _) in CHECKS.items() if default} | set(own)
    groups: dict[str, set[str]] = {"all": set(CHECKS) | set(own)}
    for name, (_, labels) in CHECKS.items():
        for label in labels:
            groups.setdefault(label, set()).add(name)
    for label, names in (registry.groups if registry else {}).items():
        groups.setdefault(label, set()).update(names)
    for entry in [e.strip() for e in (spec.split(",") if isinstance(spec, str) else spec)]:
        if not entry:
            continue
        name = entry.removeprefix("-")
        if name in groups:
            members = groups[name]
        elif name in CHECKS or name in own:
            members = {name}
        else:
            raise ValueError(f"unknown check or group: {name}")
        on = on - members if entry.startswith("-") else on | members
    return on


def list_checks(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """(name, default_on, groups) of every check."""
    rows = [(k, d, ",".join(g)) for k, (d, g) in CHECKS.items()] + [(k, True, "") for k in (registry or Registry()).enabled()]
    return spark.createDataFrame(rows, "name string, default_on boolean, groups string")


def _object(text: str, known: set[str], what: str) -> dict:
    found = json.loads(text)
    if not isinstance(found, dict):
        raise ValueError(f"{what} must be an object")
    if unknown := sorted(found.keys() - known):
        raise ValueError(f"unknown keys in {what}: {', '.join(unknown)}")
    return found


def parse_checks_config(text: str) -> list[str]:
    """Entries of a checks config: an object with nothing but ``checks``."""
    checks = _object(text, {"checks"}, "checks config").get("checks", [])
    return [checks] if isinstance(checks, str) else list(checks)


def find_checks_config(start: str, name: str = CONFIG_NAME) -> Path | None:
    """The nearest config in a folder or above it."""
    for folder in (Path(start).resolve(), *Path(start).resolve().parents):
        if (folder / name).is_file():
            return folder / name
    return None


def parse_channel_types(text: str) -> list[dict]:
    """[{type, produce, consume, category}]: ``type`` is required."""
    out = []
    for entry in json.loads(text):
        if not entry.get("type"):
            raise ValueError("a channel type needs 'type'")
        out.append({"type": entry["type"], "produce": list(entry.get("produce", [])), "consume": list(entry.get("consume", [])), "category": entry.get("category", "")})
    return out


# Keys of the organisation config.
_ORG_KEYS = {"lockTypes", "channelTypes", "featureFlags", "collapsePaths", "disabledAnnealChecks", "staticInitHazards"}


def parse_org_config(text: str, registry: Registry | None = None) -> Registry:
    """The organisation's config on top of ``registry``; unknown keys and negative groups are ``ValueError``."""
    found, out = _object(text, _ORG_KEYS, "organisation config"), registry or Registry()
    out.add("lock_types", *found.get("lockTypes", []))
    out.add("channel_types", *parse_channel_types(json.dumps(found.get("channelTypes", []))))
    for entry in found.get("featureFlags", []):
        group = entry.get("nameGroup", 0)
        if group < 0:
            raise ValueError("nameGroup must be 0 or more")
        out.add("flag_patterns", (entry["pattern"], group))
    out.add("collapse_paths", *found.get("collapsePaths", []))
    out.add("disabled", *found.get("disabledAnnealChecks", []))
    out.add("hazards", *found.get("staticInitHazards", []))
    return out
