"""Registry, configurations, presets and model cards."""

from __future__ import annotations

import dataclasses
import datetime
import inspect
import json
import os
import platform
import random
import warnings
from dataclasses import asdict, dataclass, field
from pathlib import Path

import numpy as np

from ..functions.penalties import PENALTIES, create_penalty
from ..operators.dictionary import UPDATES, OnlineUpdate
from ..operators.learn import LEARNERS, DictionaryLearner
from ..operators.solvers import SOLVERS

#: kind -> name -> class or function
_REGISTRY: dict[str, dict] = {"penalty": {}, "solver": {}, "dict_updater": {}, "learner": {}}
_NEEDS = {"penalty": ("value", "prox"), "solver": (), "dict_updater": (), "learner": ("fit",)}


def register(kind: str, name: str):
    """Decorator: add a component; an existing name is replaced with a warning."""

    def add(item):
        group = _group(kind)
        if inspect.isclass(item) and (missing := [m for m in _NEEDS[kind] if not hasattr(item, m)]):
            raise TypeError(f"a {kind} needs {', '.join(missing)}")
        if not callable(item):
            raise TypeError(f"a {kind} must be callable")
        if name in group:
            warnings.warn(f"{kind} {name!r} is replaced", stacklevel=2)
        group[name] = item
        return item

    return add


def _group(kind: str) -> dict:
    if kind not in _REGISTRY:
        raise KeyError(f"unknown kind {kind!r}; there are {', '.join(_REGISTRY)}")
    return _REGISTRY[kind]


def lookup(kind: str, name: str):
    group = _group(kind)
    if name not in group:
        raise KeyError(f"unknown {kind} {name!r}; there are {', '.join(sorted(group))}")
    return group[name]


def registered(kind: str | None = None) -> dict[str, list[str]]:
    return {k: sorted(v) for k, v in _REGISTRY.items() if kind in (None, k)}


def unregister(kind: str, name: str) -> None:
    lookup(kind, name)
    del _REGISTRY[kind][name]


def clear_registry(kind: str | None = None) -> None:
    for k in _REGISTRY:
        if kind in (None, k):
            _REGISTRY[k].clear()


def describe(kind: str, name: str) -> dict:
    """Parameters and their defaults."""
    p = inspect.signature(lookup(kind, name)).parameters.values()
    return {"kind": kind, "name": name, "parameters": {x.name: None if x.default is x.empty else repr(x.default) for x in p}}


def create(config: dict):
    """{kind, name, params} to an instance; solvers are functions and come as they are."""
    item = lookup(config["kind"], config["name"])
    return item if config["kind"] == "solver" else item(**config.get("params", {}))


def register_defaults() -> None:
    for kind, items in (("penalty", PENALTIES), ("solver", SOLVERS), ("dict_updater", {**UPDATES, "online": OnlineUpdate}), ("learner", LEARNERS)):
        for name, item in items.items():
            _REGISTRY[kind].setdefault(name, item)


register_defaults()


def default_config() -> dict:
    return {"penalty": {"name": "l1", "params": {"lam": 0.1}}, "solver": {"name": "fista", "params": {"max_iter": 200, "tol": 1e-6}}, "dict_updater": {"name": "mod", "params": {}}, "learner": {"n_atoms": 144, "n_steps": 30, "seed": 0}}


def validate_config(config: dict, strict: bool = True) -> list[str]:
    """Errors of a configuration; strict raises them."""
    errors = []
    for kind in ("penalty", "solver", "dict_updater"):
        part = config.get(kind)
        if not isinstance(part, dict) or "name" not in part:
            errors.append(f"{kind}: a name is missing")
        elif part["name"] not in _REGISTRY[kind] and not (kind == "dict_updater" and part["name"] == "ksvd"):
            errors.append(f"{kind}: unknown name {part['name']!r}")
        elif not isinstance(part.get("params", {}), dict):
            errors.append(f"{kind}: params must be a mapping")
    learner = config.get("learner", {})
    for name, low in (("n_atoms", 1), ("n_steps", 1)):
        if not isinstance(learner.get(name, low), int) or learner.get(name, low) < low:
            errors.append(f"learner: {name} must be an integer from {low}")
    errors += [f"unknown section {k!r}" for k in config if k not in ("penalty", "solver", "dict_updater", "learner", "metadata")]
    if errors and strict:
        raise ValueError("; ".join(errors))
    return errors


def compatibility(config: dict) -> list[str]:
    """Warnings about combinations that do not work well."""
    pen, sol, upd = (config[k]["name"] for k in ("penalty", "solver", "dict_updater"))
    p = PENALTIES.get(pen)
    out = []
    if sol in ("ncg", "gradient") and p and not p.differentiable:
        out.append(f"{sol} needs a differentiable penalty, {pen} is not")
    if sol == "omp" and pen not in ("l1", "top_k"):
        out.append("omp ignores the penalty")
    if upd == "ksvd" and sol not in ("omp",):
        out.append("ksvd expects codes with few atoms, as by omp")
    lam = config["penalty"].get("params", {}).get("lam", 0.1)
    if not 0.001 <= lam <= 10:
        out.append(f"lam {lam} is outside 0.001 to 10")
    return out


def learner_from(config: dict) -> DictionaryLearner:
    validate_config(config)
    return DictionaryLearner(penalty=create_penalty(config["penalty"]["name"], **config["penalty"].get("params", {})), solver=config["solver"]["name"], solver_params=config["solver"].get("params", {}), update=config["dict_updater"]["name"], **config.get("learner", {}))


def merge_configs(*configs: dict) -> dict:
    """Section by section; later ones win."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = merge_configs(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _flat(c: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in c.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def config_diff(a: dict, b: dict) -> dict:
    x, y = _flat(a), _flat(b)
    return {"added": {k: y[k] for k in y if k not in x}, "removed": {k: x[k] for k in x if k not in y}, "changed": {k: (x[k], y[k]) for k in x if k in y and x[k] != y[k]}}


def save_config(config: dict, path: str) -> None:
    validate_config(config)
    Path(path).write_text(_dump(config, path))


def load_config(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        return _yaml().safe_load(text)
    return json.loads(text)


def _dump(x: dict, path: str) -> str:
    return _yaml().safe_dump(x, sort_keys=True) if path.endswith((".yaml", ".yml")) else json.dumps(x, indent=2, sort_keys=True)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML files need PyYAML; JSON works without it") from e
    return yaml


# fixed values: published settings of well-known methods
PRESETS = {
    "olshausen_field_1996": {"penalty": {"name": "l1", "params": {"lam": 0.1}}, "solver": {"name": "fista", "params": {}}, "dict_updater": {"name": "gradient", "params": {}}, "learner": {"n_atoms": 144, "n_steps": 1000}},
    "ksvd_aharon_2006": {"penalty": {"name": "top_k", "params": {"k": 4}}, "solver": {"name": "omp", "params": {"n_atoms": 4}}, "dict_updater": {"name": "ksvd", "params": {}}, "learner": {"n_atoms": 256, "n_steps": 30}},
    "online_mairal_2010": {"penalty": {"name": "l1", "params": {"lam": 0.15}}, "solver": {"name": "fista", "params": {"max_iter": 500}}, "dict_updater": {"name": "online", "params": {}}, "learner": {"n_atoms": 200, "n_steps": 1000}},
    "elastic_net_zou_2005": {"penalty": {"name": "elastic_net", "params": {"lam": 0.15, "l1_ratio": 2 / 3}}, "solver": {"name": "fista", "params": {}}, "dict_updater": {"name": "mod", "params": {}}, "learner": {"n_atoms": 128, "n_steps": 200}},
    "robust_cauchy": {"penalty": {"name": "cauchy", "params": {"lam": 0.1}}, "solver": {"name": "ncg", "params": {}}, "dict_updater": {"name": "gradient", "params": {}}, "learner": {"n_atoms": 100, "n_steps": 100, "rate": 0.005}},
}


def preset(name: str) -> dict:
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return json.loads(json.dumps(PRESETS[name]))


def set_deterministic(seed: int = 0) -> None:
    """One thread for the numeric libraries of this process, and seeds."""
    for k in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS", "NUMEXPR_NUM_THREADS"):
        os.environ[k] = "1"
    random.seed(seed)
    np.random.seed(seed)


def is_deterministic() -> bool:
    return os.environ.get("OMP_NUM_THREADS") == "1" and os.environ.get("OPENBLAS_NUM_THREADS") == "1"


def reproducibility_info() -> dict:
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "deterministic": is_deterministic()}


@dataclass
class ModelCard:
    """What a reader should know of a learned dictionary."""

    name: str
    version: str = "1"
    description: str = ""
    training_data: str = ""
    metrics: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)
    limitations: str = ""
    intended_use: str = ""
    created: str = field(default_factory=lambda: datetime.datetime.now(datetime.timezone.utc).isoformat())

    def missing(self) -> list[str]:
        return [f.name for f in dataclasses.fields(self) if not getattr(self, f.name)]

    def save(self, path: str) -> None:
        Path(path).write_text(_dump(asdict(self), path))

    @classmethod
    def load(cls, path: str) -> ModelCard:
        return cls(**load_config(path))

    @classmethod
    def template(cls) -> str:
        return json.dumps(asdict(cls("name")), indent=2)


def training_metadata(learner: DictionaryLearner, **extra) -> dict:
    return {"config": {f.name: repr(getattr(learner, f.name)) for f in dataclasses.fields(learner) if f.name not in ("atoms", "history")}, "steps": len(learner.history), "last": learner.history[-1] if learner.history else {}, **reproducibility_info(), **extra}


def validate_implementation() -> dict[str, bool]:
    """Self-check: penalties are not negative and shrink, solvers give codes of the right shape."""
    r = np.random.default_rng(0)
    z, d, x = r.normal(size=(4, 6)), r.normal(size=(6, 5)), r.normal(size=(4, 5))
    out = {}
    for name, p in PENALTIES.items():
        pen = p()
        q = pen.np_prox(np.abs(z) if name == "non_negative_l1" else z, 0.5)
        out[f"penalty {name}"] = bool(q.shape == z.shape and (pen.np_value(q) >= -1e-12).all() and np.linalg.norm(q) <= np.linalg.norm(z) + 1e-9)
    for name, s in SOLVERS.items():
        pen = PENALTIES["cauchy"]() if name in ("ncg", "gradient", "log_prior") else PENALTIES["l1"]()
        out[f"solver {name}"] = s(x, d, pen).a.shape == (4, 6)
    return out
