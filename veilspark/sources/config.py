"""Settings, policies and the dictionary of public names."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from veilspark.functions import known


@dataclass(frozen=True)
class Settings:
    regions: dict | None = None
    stage: str = "L2"
    live: bool = True
    overlay: bool = True
    auto_find: bool = True
    regions_from: str | None = None
    learned_colours: dict = field(default_factory=dict)
    extra_known_names: tuple = ()

    @classmethod
    def load(cls, path: str) -> Settings:
        """What a file says over the defaults; a missing or broken file says nothing."""
        try:
            given = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            return cls()
        return replace(cls(), **{k: v for k, v in given.items() if k in cls.__dataclass_fields__})

    def save(self, path: str, **changes) -> Settings:
        new = replace(self, **changes)
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(json.dumps(asdict(new), indent=2))
        return new


def _text(v) -> str:
    return v.strip() if isinstance(v, str) else ""


def _texts(v) -> tuple[str, ...]:
    return tuple(_text(x) for x in v if _text(x)) if isinstance(v, list) else ()


@dataclass(frozen=True)
class Policy:
    enabled: bool = True
    default_stage: str = "L2"
    page_setup: dict | None = None
    extra_known_names: tuple[str, ...] = ()
    support_contact: str = ""

    @classmethod
    def of(cls, raw) -> Policy:
        """What has the right type of an administrator's settings."""
        r = raw if isinstance(raw, dict) else {}
        return cls(r.get("enabled") is not False, "L1" if r.get("defaultStage") == "L1" else "L2", page_setup(r.get("pageSetup")), _texts(r.get("extraKnownNames")), _text(r.get("supportContact"))[:200])


def page_setup(v) -> dict | None:
    if not isinstance(v, dict) or not _text(v.get("leftDocument")) or not _text(v.get("rightDocument")):
        return None
    out = {"leftDocument": _text(v["leftDocument"]), "rightDocument": _text(v["rightDocument"])}
    if isinstance(label := v.get("label"), dict):
        single = {k: _text(label.get(k)) for k in ("rightLabelSpan", "labelNameFromChild") if _text(label.get(k))}
        out["label"] = {**single, **{k: list(_texts(label.get(k))) for k in ("labelNameAttributes", "labelClassPrefixes", "ignoreInText")}}
    return out


def first_setup(*setups: dict | None) -> dict | None:
    """The saved setup before the policy's before what was found."""
    return next((s for s in setups if s), None)


def load_dictionary(spark: SparkSession, path: str, extra: Iterable[str] = ()) -> int:
    """Puts the nested JSON file at path in the place of the built-in dictionary; its number of names."""
    source = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if extra:
        source["organisation_list"] = list(extra)
    known.use(json.dumps(source))
    return len(list(known.entries(source)))


def dictionary_frame(spark: SparkSession) -> DataFrame:
    """(key, name, category), small, for joins."""
    rows = [(known.key(n), n, c) for n, c in known.entries(json.loads(known.current()))]
    return spark.createDataFrame(rows, "key string, name string, category string")
