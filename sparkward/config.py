"""Configurations of runs, derived from a base configuration. Plain dictionaries; see sources.json_tables.load_config."""

from __future__ import annotations

from sparkward.sources.contracts import ContractError
from sparkward.sources.json_tables import deep_merge


def default_run(config: dict) -> dict:
    """The base with what a run needs to be repeatable: no sampling, taint analysis on."""
    return deep_merge(config, {"generation": {"temperature": 0}, "eval": {"enable_taint": True}})


def analyser_only_run(config: dict, suffix: str = "_bandit_only") -> dict:
    """The same run with result files of its own, for detection by the external analyser alone."""
    outputs = config.get("outputs", {})
    if not isinstance(outputs, dict):
        raise ContractError("outputs must be a dictionary")
    renamed = {k: v.removesuffix(".json") + f"{suffix}.json" if isinstance(v, str) and v.endswith(".json") else v for k, v in outputs.items()}
    return {**config, "outputs": renamed}
