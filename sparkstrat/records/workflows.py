"""Model-training workflow files as graphs of records: what a workflow declares, and how far it is understood. Nothing is trained or run."""

from __future__ import annotations

from pathlib import Path

#: The classes that workflow files name and that have a record of their own, by section.
KNOWN = {
    "model": ("LGBModel", "XGBModel", "DNNModel", "LinearModel"),
    "handler": ("Alpha158", "Alpha360"),
    "strategy": ("TopkDropoutStrategy",),
    "record": ("SignalRecord", "PortAnaRecord"),
    "processor": ("DropnaLabel", "CSRankNorm", "RobustZScoreNorm", "Fillna"),
}
RECORD_TOKENS = {"SignalRecord": "record.signal_record", "PortAnaRecord": "record.portfolio_analysis_record"}


def _map(value) -> dict:
    return value if isinstance(value, dict) else {}


def _part(raw, section: str) -> dict | None:
    """class, module, kwargs and support of a component: known, custom_required, or generic_record if it names no class."""
    if not isinstance(raw, dict) or not raw:
        return None
    name = raw.get("class") if isinstance(raw.get("class"), str) else None
    support = "generic_record" if name is None else "known" if name in KNOWN[section] else "custom_required"
    return {"class": name, "module": raw.get("module_path"), "kwargs": _map(raw.get("kwargs")), "support": support}


def extract(config: dict) -> dict:
    """The components of a workflow: model, dataset, records, strategy, backtest."""
    task = _map(config.get("task"))
    section = lambda name: config.get(name, task.get(name))
    dataset = _part(section("dataset"), "handler")
    if dataset:
        handler = _part(dataset["kwargs"].get("handler"), "handler") or {"class": None, "kwargs": {}, "support": "generic_record"}
        dataset |= {"handler": handler["class"], "handler_kwargs": handler["kwargs"], "segments": _map(dataset["kwargs"].get("segments")), "support": handler["support"]}
        del dataset["kwargs"]
    raw = section("record") or []
    records = [r for r in (_part(x, "record") for x in (raw if isinstance(raw, list) else [raw])) if r]
    strategy = backtest = None
    for r in records:
        settings = _map(r["kwargs"].get("config"))
        if settings.get("strategy") or settings.get("backtest"):
            strategy, backtest = _part(settings.get("strategy"), "strategy"), _map(settings.get("backtest")) or None
            break
    return {"model": _part(section("model"), "model"), "dataset": dataset, "records": records, "strategy": strategy, "backtest": backtest}


def unsupported(found: dict) -> list[dict]:
    """The components that need code of their own."""
    out = []

    def note(part, kind: str, name: str | None) -> None:
        if part and part["support"] == "custom_required":
            out.append({"kind": f"custom_{kind}", "name": name or f"unknown_{kind}"})

    note(found["model"], "model", (found["model"] or {}).get("class"))
    note(found["dataset"], "data_handler", (found["dataset"] or {}).get("handler"))
    for key in ("learn_processors", "infer_processors"):
        for p in (found["dataset"] or {}).get("handler_kwargs", {}).get(key) or ():
            name = p.get("class") if isinstance(p, dict) else p
            if name not in KNOWN["processor"]:
                out.append({"kind": "custom_processor", "name": str(name)})
    note(found["strategy"], "strategy", (found["strategy"] or {}).get("class"))
    for r in found["records"]:
        note(r, "record", r["class"])
    return out


def classification(tokens: list[str], missing: list[dict]) -> str:
    if tokens:
        return "partially_supported" if missing else "supported"
    return "custom_token_required" if missing else "non_goal"


def import_workflow(config: dict, source: str = "workflow") -> dict:
    """A graph document of a workflow's records, with what is not understood in its metadata."""
    found, nodes = extract(config), []

    def add(name: str, token: str, params: dict, **inputs) -> None:
        nodes.append({"id": name, "token": token, "version": "1", "inputs": {k: v for k, v in inputs.items() if v}, "params": params})

    if found["dataset"]:
        add("dataset", "data.dataset_record", found["dataset"])
    if found["model"]:
        add("model", "model.forecast_model_record", found["model"], dataset="dataset.record" if found["dataset"] else None)
    model = "model.record" if found["model"] else None
    for i, r in enumerate(found["records"], 1):
        add(f"record_{i}", RECORD_TOKENS.get(r["class"], "record.generic_record"), r, model=model)
    if found["strategy"]:
        add("strategy", "selection.topk_dropout_record" if found["strategy"]["class"] in KNOWN["strategy"] else "strategy.generic_record", found["strategy"], signal=model)
    if found["backtest"]:
        add("backtest_config", "portfolio.backtest_config_record", found["backtest"], strategy="strategy.record" if found["strategy"] else None)
    tokens = sorted({n["token"] for n in nodes} | ({f"feature.{found['dataset']['handler'].lower()}_record"} if found["dataset"] and found["dataset"]["handler"] in KNOWN["handler"] else set()))
    missing = unsupported(found)
    metadata = {"source": source, "classification": classification(tokens, missing), "tokens": tokens, "unsupported": missing, "lossless": False, "runs": False}
    return {"capabilities": ["core"], "strategy": {"id": Path(source).stem or "workflow", "version": 1, "nodes": nodes, "outputs": {"record": f"{nodes[-1]['id']}.record"} if nodes else {}}, "metadata": metadata}


def import_file(path: str) -> dict:
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("WORKFLOW_INVALID")
    return import_workflow(raw, path)
