"""Tools over the catalog and the loop that calls them. Models are injected; the retrieval-only policy needs none."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .operators import hybrid, mentions, windows
from .operators.text_index import TextIndex

Tool = Callable[..., DataFrame]


@dataclass
class Library:
    """What the tools read."""

    evidence: DataFrame | TextIndex
    units: DataFrame
    videos: DataFrame
    extra: dict[str, Tool] = field(default_factory=dict)

    def tools(self) -> dict[str, Tool]:
        """Built-in tools; those registered under the same name win."""
        own: dict[str, Tool] = {
            "search": lambda query, k=8, videos=None: hybrid.with_texts(hybrid.search(self.evidence, self.units, query, min(k, 20), videos, per_video=None if videos and len(videos) == 1 else 3), self.evidence),
            "find_mentions": lambda terms, **kw: mentions.mentions(self.evidence, terms, **kw),
            "count_mentions": lambda terms: mentions.by_channel(mentions.mentions(self.evidence, terms), self.videos, terms),
            "library_stats": lambda: mentions.library(self.videos),
            "list_videos": lambda: self.videos.orderBy("id"),
            "time_window": lambda video_id, t0, t1: windows.time_window(self.evidence if isinstance(self.evidence, DataFrame) else self.evidence.rows(), video_id, t0, t1),
        }
        return own | self.extra


class Policy(ABC):
    @abstractmethod
    def next_step(self, question: str, past: list[tuple[str, dict, list]]) -> tuple[str, dict] | str:
        """The next tool call, or the answer."""


class RetrievalOnly(Policy):
    """One search with the question's words, then an answer that cites what it found."""

    def next_step(self, question, past):
        if not past:
            return "search", {"query": question}
        hits = past[0][2]
        return "\n".join(f"{h['evidence'][0]['text'][:160]} [[cite:{h['video_id']}:{h['u0']:.0f}-{h['u1']:.0f}]]" for h in hits) or "Nothing found."


def ask(library: Library, question: str, policy: Policy, most_calls: int = 20) -> tuple[str, list[str]]:
    """The policy's answer and the tools that it called."""
    past: list[tuple[str, dict, list]] = []
    tools = library.tools()
    while True:
        step = policy.next_step(question, past)
        if isinstance(step, str):
            return step, [p[0] for p in past]
        if len(past) >= most_calls:
            return "", [p[0] for p in past]
        name, args = step
        past.append((name, args, [r.asDict(recursive=True) for r in tools[name](**args).collect()]))
