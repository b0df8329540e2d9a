"""Operator registry, the order of stages, and which of them need to run."""

from __future__ import annotations

import json
from abc import ABC
from collections.abc import Callable
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Operator(ABC):
    """A stage: named kinds of rows in, kinds of rows out. ``run`` maps tables by kind to tables by kind."""

    id: str
    version: int = 1
    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)
    replayable: bool = True
    run: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None

    def cache_key(self, content: str, providers: dict[str, str] | None = None) -> str:
        """Equal for equal content, version, settings and the providers it is bound to."""
        return sha256(self._keyed(content, providers).encode()).hexdigest()

    def _keyed(self, content: str, providers: dict[str, str] | None) -> str:
        used = {r: (providers or {}).get(r) for r in self.roles}
        return json.dumps([self.id, self.version, content, self.params, used], sort_keys=True)

    def cache_keys(self, content: Column, providers: dict[str, str] | None = None) -> Column:
        """``cache_key`` of a column of content keys (hex)."""
        head, tail = self._keyed("\0", providers).split("\\u0000")
        return F.sha2(F.concat(F.lit(head), content, F.lit(tail)), 256)


class Registry:
    """Operators by id; one registered later under a name takes it."""

    def __init__(self):
        self.known: dict[str, Operator] = {}

    def add(self, op: Operator) -> Operator:
        self.known[op.id] = op
        return op

    def operator(self, id: str, **spec):
        """Decorator: a function over tables as an operator."""

        def make(run):
            return self.add(Operator(id=id, run=run, **spec))

        return make

    def ordered(self, ids: list[str], bound: set[str] | None = None) -> list[Operator]:
        """The stages of a policy so that producers come first; ties keep the policy's order."""
        missing = [i for i in ids if i not in self.known]
        if missing:
            raise ValueError(f"unknown operators: {missing}")
        ops = [self.known[i] for i in ids]
        if bound is not None and (unbound := [(o.id, r) for o in ops for r in o.roles if r not in bound]):
            raise ValueError(f"roles without a provider: {unbound}")
        makers: dict[str, list[str]] = {}
        for o in ops:
            for k in o.outputs:
                makers.setdefault(k, []).append(o.id)
        for o in ops:
            if lost := [k for k in o.inputs if k not in makers]:
                raise ValueError(f"nothing makes {lost} for {o.id}")
        before = {o.id: {m for k in (*o.inputs, *o.optional) for m in makers.get(k, []) if m != o.id} for o in ops}
        out: list[Operator] = []
        while len(out) < len(ops):
            done = {o.id for o in out}
            ready = next((o for o in ops if o.id not in done and before[o.id] <= done), None)
            if ready is None:
                raise ValueError("the operators form a cycle")
            out.append(ready)
        return out


def actions(stages: list[Operator], cached: set[str]) -> dict[str, str]:
    """run, replay or skip for each stage.

    A stage that isn't cached runs. A cached one is replayed if a stage that runs
    reads what it makes and it can be; if it can't, it runs again; else it is
    skipped. What runs again needs its own inputs in turn.
    """
    out = {s.id: "skip" if s.id in cached else "run" for s in stages}
    for s in reversed(stages):
        needed = any(out[t.id] == "run" and set(s.outputs) & {*t.inputs, *t.optional} for t in stages if t.id != s.id)
        if out[s.id] == "skip" and needed:
            out[s.id] = "replay" if s.replayable else "run"
    return out


def execute(stages: list[Operator], tables: dict[str, DataFrame], cached: dict[str, dict[str, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Run a plan: each stage sees the tables made so far; declared outputs are checked."""
    cached = cached or {}
    todo, out = actions(stages, set(cached)), dict(tables)
    for s in stages:
        made = cached[s.id] if todo[s.id] in ("replay", "skip") else (s.run({k: out[k] for k in (*s.inputs, *s.optional) if k in out}) if s.run else {})
        if extra := set(made) - set(s.outputs):
            raise ValueError(f"{s.id} made {sorted(extra)}, which it doesn't declare")
        for kind, rows in made.items():
            out[kind] = out[kind].unionByName(rows) if kind in out else rows
    return out


def estimate(secs: float | Column, samples: int | Column, audio: bool | Column, prices: dict[str, float]) -> float | Column:
    """Cost of a video, or of a column of videos: per minute of speech recognised, per frame embedded or described."""
    heard = audio.cast("double") if isinstance(audio, Column) else float(audio)
    return secs / 60 * prices.get("speech_minute", 0.0) * heard + samples * prices.get("frame", 0.0)
