"""Versioned states of online models: plain JSON of settings, statistics, samples and trees, optionally compressed.

A state names its version and its classes' fields, not their code: fields that
an older state lacks take their defaults, and older layouts are brought up to
date step by step by UPGRADES.  A restored model goes on exactly as the one
that was saved: trees keep their cuts, and random numbers their place.
"""

from __future__ import annotations

import dataclasses
import json
import random
import zlib
from collections.abc import Callable
from typing import Any

from ..operators.caster import Caster, ErrorTracker
from ..operators.detector import Detector, Result, StreamForest
from ..operators.deviation import Deviation
from ..operators.lockstep import Seat
from ..operators.multi import Bandit, MultiSeries, SeriesState
from ..operators.predictive import PredictiveForest
from ..operators.thresholder import Thresholder
from ..operators.transforms import Stats, Transform
from ..operators.trees import DynamicTree

VERSION = 2
CLASSES = {c.__name__: c for c in (Detector, Result, StreamForest, Deviation, Bandit, MultiSeries, SeriesState, Thresholder, Stats, Transform, Caster, ErrorTracker, PredictiveForest)}


def _signs(state: dict) -> dict:
    """Version 1 kept each sample as (key, number, point) in any order; now it is a heap of (-key, number, point)."""

    def walk(x: Any) -> Any:
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, dict):
            x = {k: walk(v) for k, v in x.items()}
            if x.get("class") == "StreamForest":
                x["fields"]["samples"] = [sorted([-k, n, p] for k, n, p in sample) for sample in x["fields"]["samples"]]
            return x
        return x

    return {**walk(state), "version": 2}


#: By version: how a state of that version becomes one of the next.
UPGRADES: dict[int, Callable[[dict], dict]] = {1: _signs}


def _node(n: DynamicTree.Node | None, points: dict[tuple, int]) -> list | None:
    if n is None:
        return None
    if n.dim < 0:
        return [n.mass, points.setdefault(n.point, len(points))]
    return [n.dim, n.cut, n.mass, _node(n.left, points), _node(n.right, points)]


def _grown(node: list | None, points: list[tuple], up: DynamicTree.Node | None) -> DynamicTree.Node | None:
    if node is None:
        return None
    if len(node) == 2:
        p = points[node[1]]
        return DynamicTree.Node(p, list(p), list(p), node[0], up)
    n = DynamicTree.Node((), [], [], node[2], up)
    n.dim, n.cut = node[0], node[1]
    n.left, n.right = _grown(node[3], points, n), _grown(node[4], points, n)
    n.low = [min(a, b) for a, b in zip(n.left.low, n.right.low, strict=True)]
    n.high = [max(a, b) for a, b in zip(n.left.high, n.right.high, strict=True)]
    return n


def _plain(x: Any) -> Any:
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, list):
        return [_plain(v) for v in x]
    if isinstance(x, tuple):
        return {"tuple": [_plain(v) for v in x]}
    if isinstance(x, dict):
        return {"items": [[_plain(k), _plain(v)] for k, v in x.items()]}
    if isinstance(x, random.Random):
        version, inner, gauss = x.getstate()
        return {"random": [version, list(inner), gauss]}
    if isinstance(x, StreamForest):
        points: dict[tuple, int] = {}
        trees = [_node(t.root, points) for t in x.trees]
        samples = [[[k, n, points[p]] for k, n, p in s] for s in x.samples]
        rest = {k: _plain(v) for k, v in vars(x).items() if k not in ("trees", "samples")}
        return {"class": "StreamForest", "fields": {**rest, "points": [list(p) for p in points], "trees": trees, "samples": samples}}
    if isinstance(x, Seat):  # as the forest that would leave it
        if x.left or not x.bank.width:
            return _plain(x.forest())
        rng, points, trees, samples = x.bank.state(x)
        rest = {"capacity": x.capacity, "decay": x.decay, "accept": x.bank.accept, "rng": _plain(rng), "updates": x.updates, "shift": 0.0, "frozen": False, "paused": False}
        return {"class": "StreamForest", "fields": {**rest, "points": points, "trees": trees, "samples": samples}}
    name = type(x).__name__
    if CLASSES.get(name) is not type(x):
        raise TypeError(f"no state of a {name}")
    return {"class": name, "fields": {k: _plain(v) for k, v in vars(x).items()}}


def _made(x: Any) -> Any:
    if isinstance(x, list):
        return [_made(v) for v in x]
    if not isinstance(x, dict):
        return x
    if "tuple" in x:
        return tuple(_made(v) for v in x["tuple"])
    if "items" in x:
        return {_made(k): _made(v) for k, v in x["items"]}
    if "random" in x:
        version, inner, gauss = x["random"]
        out = random.Random()
        out.setstate((version, tuple(inner), gauss))
        return out
    fields, kind = x["fields"], CLASSES[x["class"]]
    if kind is StreamForest:
        forest = StreamForest(0, fields["capacity"], fields["decay"], 0)
        vars(forest).update({k: _made(v) for k, v in fields.items() if k not in ("points", "trees", "samples")})
        points = [tuple(p) for p in fields["points"]]
        forest.samples = [[(k, n, points[p]) for k, n, p in s] for s in fields["samples"]]
        forest.trees = []
        for node in fields["trees"]:
            tree = DynamicTree(forest.rng.random)
            tree.root = _grown(node, points, None)
            forest.trees.append(tree)
        return forest
    out = kind.__new__(kind)
    if dataclasses.is_dataclass(kind):  # what an older state lacks
        for f in dataclasses.fields(kind):
            if f.name not in fields and f.default is not dataclasses.MISSING:
                setattr(out, f.name, f.default)
            elif f.name not in fields and f.default_factory is not dataclasses.MISSING:
                setattr(out, f.name, f.default_factory())
    vars(out).update({k: _made(v) for k, v in fields.items()})
    if kind is Detector:
        for name, value in (("early", []), ("foretold", None)):
            vars(out).setdefault(name, value)
    return out


def dump(model: Any, compress: bool = True) -> bytes:
    """The state of a Detector, Caster, PredictiveForest, StreamForest or MultiSeries."""
    text = json.dumps({"version": VERSION, "model": _plain(model)}, separators=(",", ":")).encode()
    return zlib.compress(text, 1) if compress else text


def load(state: bytes) -> Any:
    """The model of a state of this version or an older one."""
    state = json.loads(zlib.decompress(state) if state[:1] == b"\x78" else state)
    while state["version"] < VERSION:
        state = UPGRADES[state["version"]](state)
    if state["version"] > VERSION:
        raise ValueError(f"a state of version {state['version']} is newer than this code")
    return _made(state["model"])
