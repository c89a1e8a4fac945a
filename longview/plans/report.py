"""Batch reports: a list of section specs, one output table per section."""

from __future__ import annotations

import copy
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame

from longview.plans.view import ViewSpec, run_view
from longview.sources import sinks

log = logging.getLogger(__name__)

# Ways to add comparisons with a base scenario to a report.
DIFF_MODES = ("No", "Yes", "Base + Diff", "Diff Only")


@dataclass(frozen=True)
class SectionResult:
    name: str
    path: str | None
    error: str | None = None


def _as_diff(section: dict, base: str) -> dict:
    out = copy.deepcopy(section)
    out["name"] += f" - difference from {base}"
    out["modify"] = "diff"
    if "sheet_name" in out:
        out["sheet_name"] += "_diff"
    return out


def _as_base(section: dict) -> dict:
    out = copy.deepcopy(section)
    out["name"] += " - base"
    out["modify"] = "base_only"
    if "sheet_name" in out:
        out["sheet_name"] += "_base"
    return out


def expand_report(sections: list[dict], mode: str, base: str) -> list[dict]:
    """Add difference and base-only variants of every section that sets no ``modify``."""
    if mode not in DIFF_MODES:
        raise ValueError(f"unknown difference mode {mode!r}")
    out = []
    for s in sections:
        if "modify" in s or mode == "No":
            out.append(s)
        elif mode == "Yes":
            out += [s, _as_diff(s, base)]
        elif mode == "Base + Diff":
            out += [_as_base(s), _as_diff(s, base)]
        else:
            out.append(_as_diff(s, base))
    return out


def section_config(section: dict, catalog: dict | None = None, base: str | None = None) -> dict:
    """Full settings of a section: preset, then its variant, then its own config."""
    config: dict = {"filter": {}}
    if "result" in section:
        config["result"] = section["result"]
        if "preset" in section:
            config.update(copy.deepcopy(catalog[section["result"]]["presets"][section["preset"]]))
            config.setdefault("filter", {})
    if section.get("modify") == "base_only":
        config["filter"]["scenario"] = [base]
    elif section.get("modify") == "diff":
        config |= {"adv_op3": "Difference", "adv_col3": "scenario", "adv_col_base3": base}
    own = dict(section.get("config", {}))
    config["filter"].update(own.pop("filter", {}))
    config.update(own)
    return config


def run_report(spark, source, sections: list[dict], out: str, mode: str = "No", base: str | None = None,
               catalog: dict | None = None, fmt: str = "csv", orders: dict | None = None,
               sources: list[str] | None = None, defaults: dict | None = None, now=None) -> list[SectionResult]:
    """Write one table per section into a new folder below ``out``.

    ``source`` is a DataFrame, or a function from a result name to its DataFrame.
    Each section reads only its own columns and filters from its source, so nothing is
    kept between sections.  A section that fails is logged and skipped.
    """
    target = f"{out}/report-{sinks.stamp(now)}"
    plan = expand_report(sections, mode, base)
    loaded: dict[str | None, DataFrame] = {}
    done = []
    # Written first: a folder that is already there fails before any section runs.
    sinks.write_table(sinks.build_info(spark, sources or [], defaults or {}, now), f"{target}/meta.{fmt}", fmt)
    for i, section in enumerate(plan, start=1):
        name = section.get("sheet_name", f"{i}_{section['name']}")
        path = f"{target}/{sinks.safe_name(name)}.{fmt}"
        try:
            config = section_config(section, catalog, base)
            key = config.get("result")
            if key not in loaded:
                loaded[key] = source(key) if callable(source) else source
            data = loaded[key]
            if not section.get("download_full_source"):
                data = run_view(data, ViewSpec.from_dict(config), orders)
            sinks.write_table(data, path, fmt)
            done.append(SectionResult(section["name"], path))
        except Exception as e:  # a broken section must not stop the others
            log.warning("section %s failed: %s", section.get("name"), e)
            done.append(SectionResult(section.get("name", str(i)), None, str(e)))
    return done
