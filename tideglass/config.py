"""Configuration of a site: small files that the driver reads and hands to plans as rows or settings.

YAML needs the yaml package; JSON and TOML always work.
"""

from __future__ import annotations

import base64
import json
import os
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

from tideglass.operators.offers import Profile

SITE_FILE = "site.toml"
# Kinds of operators that can be official, and those that a service may crawl without saying so; keys of a service account.
OFFICIAL = ["municipality", "municipality_affiliated", "prefecture", "tourism_association", "facility_official", "transport_operator"]
DEFAULT_CRAWLABLE = ["municipality", "municipality_affiliated"]
ACCOUNT_KEYS = ["client_email", "private_key", "token_uri"]
#: What a source must have; further keys of its entry are left out.
SOURCE = "id string, name string, operator string, operator_kind string, policy string, official_url string, pages array<struct<url:string,kind:string>>, allow_hosts array<string>, delay_seconds double, max_pages int"


def load(path: str | Path) -> Any:
    """A JSON, TOML or YAML file by its ending; None where there is none."""
    path = Path(path)
    if not path.is_file():
        return None
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    if path.suffix in (".yaml", ".yml"):
        if yaml is None:
            raise RuntimeError(f"{path} needs the yaml package")
        return yaml.safe_load(text)
    return json.loads(text)


def find_root(start: str | Path | None = None) -> Path:
    """The nearest folder upwards that has a site file."""
    here = Path(start or ".").resolve()
    for folder in (here, *here.parents):
        if (folder / SITE_FILE).is_file():
            return folder
    raise FileNotFoundError(f"no {SITE_FILE} in {here} or above")


def site_settings(root: str | Path) -> dict[str, Any]:
    """The site file with its [site] table opened up: the other tables stay under their names."""
    data = load(Path(root) / SITE_FILE) or {}
    return data.get("site", {}) | {k: v for k, v in data.items() if k != "site"}


def secret(root: str | Path, name: str, required: bool = False) -> str | None:
    """A secret from the environment, else from the site's .env, and from nowhere else. Empty ones don't count; references that weren't resolved are an error."""
    given = dict(line.split("=", 1) for line in _lines(Path(root) / ".env") if "=" in line and not line.startswith("#"))
    value = (os.environ.get(name) or given.get(name, "")).strip().strip("\"'")
    if value.startswith("op://"):
        raise ValueError(f"{name} is an unresolved reference")
    if required and not value:
        raise ValueError(f"{name} isn't set")
    return value or None


def _lines(path: Path) -> list[str]:
    return path.read_text(encoding="utf-8").splitlines() if path.is_file() else []


def service_account(raw: str) -> dict[str, str]:
    """The key of a service account, as JSON or as base64 of it."""
    text = raw.strip()
    info = json.loads(text if text.startswith("{") else base64.b64decode(text, validate=True))
    if missing := [k for k in ACCOUNT_KEYS if not info.get(k)]:
        raise ValueError(f"a service account needs {', '.join(missing)}")
    return info


def sources(spark: SparkSession, path: str | Path, key: str = "sources") -> DataFrame:
    """The sources of a file as rows; the same id twice is an error."""
    names = [f.split()[0] for f in SOURCE.split(", ")]
    rows = [{n: e.get(n) for n in names} for e in (load(path) or {}).get(key) or []]
    ids = [r["id"] for r in rows]
    if twice := sorted({i for i in ids if ids.count(i) > 1}):
        raise ValueError(f"{path} has {', '.join(twice)} more than once")
    return spark.createDataFrame(rows, SOURCE)


def gate(found: DataFrame, declared: list[str] | None = None) -> DataFrame:
    """id, operator_kind of the sources that are to be crawled but may not be: their operator isn't of a declared kind. Kinds that can't be official can't be declared."""
    allowed = DEFAULT_CRAWLABLE if declared is None else declared
    if wrong := sorted(set(allowed) - set(OFFICIAL)):
        raise ValueError(f"{', '.join(wrong)} can't be crawled")
    return found.filter((F.col("policy") == "crawl") & ~F.coalesce(F.col("operator_kind").isin(allowed), F.lit(False))).select("id", "operator_kind")


def profile(data: dict[str, Any]) -> Profile:
    """A screening profile from its configuration; one without funnels is an error."""
    funnels = [(f["kind"], list(f["keywords"])) for f in data.get("funnels") or []]
    if not funnels:
        raise ValueError("a profile needs funnels")
    tiers = [(t["id"], float(t["score"]), list(t["keywords"])) for t in data.get("conditions") or []]
    exclusions = [(e["reason"], list(e["keywords"])) for e in data.get("exclusions") or []]
    known = {k: v for k, v in (data.get("thresholds") or {}).items() if k in Profile.__dataclass_fields__}
    return Profile(funnels=funnels, tiers=tiers, exclusions=exclusions, areas=list(data.get("areas") or []), **known)


def flattened(data: dict[str, Any] | None, prefix: str = "") -> dict[str, str]:
    """Nested wording as one level, with points between the keys."""
    out: dict[str, str] = {}
    for key, value in (data or {}).items():
        if isinstance(value, dict):
            out |= flattened(value, f"{prefix}{key}.")
        elif value is not None:
            out[f"{prefix}{key}"] = str(value)
    return out


def catalog(spark: SparkSession, folder: str | Path, codes: list[str]) -> DataFrame:
    """locale, key, text of the wording files of some locales; a locale without a file has none. ``site.translations`` falls back on the default locale."""
    rows = []
    for code in codes:
        data = next((d for s in (".yaml", ".json", ".toml") if (d := load(Path(folder) / f"{code}{s}")) is not None), None)
        rows += [(code, k, v) for k, v in flattened(data).items()]
    return spark.createDataFrame(rows, "locale string, key string, text string")


def review_queue(spark: SparkSession, path: str | Path) -> DataFrame:
    """id, url, title, policy, note of the candidates that wait for a decision or had one."""
    rows = (load(path) or {}).get("candidates") or []
    return spark.createDataFrame([tuple(r.get(k) for k in ("id", "url", "title", "policy", "note")) for r in rows], "id string, url string, title string, policy string, note string")
