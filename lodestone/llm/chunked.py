"""Bounded memory of what an encoder makes of the pieces of a text.

Patterns of byte-level BPE start a match at every lone space between two non-space characters (only white-space runs
hold a space inside), so a text may be cut there and each piece encoded by itself. Where a space meets other white
space the text is handed over whole.
"""
from __future__ import annotations

import gc
import re
import sys
import types

_BEFORE, _AFTER = re.compile(r" (?=\s)"), re.compile(r" (?<=\s )")
_LONE = re.compile(r"[A-Za-z] (?=[A-Za-z])")
CACHE, GROUP_CHARS, LONGEST, SLICE = 250_000, 1_000_000, 64, 200_000


def per_process(key, build):
    """build() once per worker process: Spark reuses workers, so later tasks find tables and models warm."""
    kept = sys.modules.setdefault("_lodestone_kept", types.ModuleType("_lodestone_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def chunks(text: str) -> list[str]:
    """Pieces cut before each lone space; the whole text where a space meets other white space."""
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    if _BEFORE.search(text) or _AFTER.search(text) or text[0] == " " or text[-1] == " ":
        return [text]
    return [parts[0], *[" " + p for p in parts[1:]]]


def slices(text: str, size: int = SLICE) -> list[str]:
    """The text in parts of about `size`, cut before lone spaces between letters; longer where there is none."""
    out, at = [], 0
    while len(text) - at > size:
        m = _LONE.search(text, at + size)
        if m is None:
            break
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


class Chunked:
    """resolve(list of pieces) gives a value for each; two generations of at most CACHE values are kept."""

    def __init__(self, resolve):
        gc.disable()  # nothing here is cyclic, and the collector would walk the tables over and over
        self.resolve, self.new, self.old = resolve, {}, {}

    def _group(self, texts: list[str]) -> list[list]:
        split = [chunks(t) if t else [] for t in texts]
        missing = set()
        for parts in split:
            missing.update(parts)
        missing -= self.new.keys()
        if kept := missing & self.old.keys():
            self.new.update((c, self.old[c]) for c in kept)
            missing -= kept
        todo = list(missing)
        fresh = dict(zip(todo, self.resolve(todo))) if todo else {}
        short = {c: v for c, v in fresh.items() if len(c) <= LONGEST}
        self.new.update(short)
        long = {c: v for c, v in fresh.items() if len(c) > LONGEST}
        get = self.new.__getitem__
        out = [[long[c] if c in long else get(c) for c in parts] if long else list(map(get, parts)) for parts in split]
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        return out

    def values(self, texts: list[str]):
        """The values of each text's pieces, in order; texts are taken about GROUP_CHARS at a time."""
        group, size = [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)
