"""URL filters: all rules at once, as glob patterns in one bit-parallel automaton over canonical URLs.

A canonical URL is the host in lower case followed by the path. In a glob ``*`` stands for any run of
characters within the host or one part of the path, ``**`` for any run at all, ``?`` for one character
that is no slash; a backslash takes the next character as it is. Every pattern is a run of bits,
one per byte and one more at its start: a byte read moves a bit up where the pattern has this byte, and
keeps it where a wildcard stands. The bits of all patterns lie end to end in 64-bit words, so one
step serves all of them, for many URLs side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.bytescan import flat, slices

ALLOW, BLOCK = "allow", "block"

# Verdict, host and path of the rules of sites.
SITE_RULES = (
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
)

# What no rule of a site decides: no host, gambling, files that are no text, pages for members.
GLOBS = (
    (BLOCK, ""),
    (BLOCK, "/**"),
    (BLOCK, "*casino**"),
    (BLOCK, "*-bets.**"),
    (BLOCK, "**.jpg"),
    (BLOCK, "**.png"),
    (BLOCK, "**.gif"),
    (BLOCK, "**.css"),
    (BLOCK, "**.js"),
    (BLOCK, "**.mp4"),
    (BLOCK, "**.zip"),
    (BLOCK, "**.exe"),
    (BLOCK, "*/**login"),
    (BLOCK, "*/**login/**"),
    (BLOCK, "*/wp-admin/**"),
    (BLOCK, "*/cgi-bin/**"),
)
DEFAULT = ALLOW

# Numbers of 64 bits that hold the states of a block of URLs, and the largest tables of an automaton.
BLOCK_WORDS = 1 << 18
MOST_WORDS = 1 << 14
# URLs still being read below which each is read by itself.
FEW = 16

_SLASH, _CONTINUED = ord("/"), range(0x80, 0xC0)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def quoted(text: str) -> str:
    """A glob that only this text matches."""
    return "".join("\\" + c if c in "\\*?" else c for c in text)


def _parts(glob: str) -> list[str | bytes]:
    """Wildcards as str, all other characters as their bytes."""
    out, at = [], 0
    while at < len(glob):
        if glob[at] == "\\" and at + 1 < len(glob):
            out.append(glob[at + 1].encode())
            at += 2
        elif glob.startswith("**", at):
            out.append("**")
            at += 2
        elif glob[at] in "*?":
            out.append(glob[at])
            at += 1
        else:
            out.append(glob[at].encode())
            at += 1
    return out


class Automaton:
    """Globs in the order of their precedence; ``first`` says which one matches a text first."""

    def __init__(self, globs: Sequence[str]):
        # Bytes that move a bit up to each place, and those that keep it there.
        moves: list[Sequence[int]] = []
        keeps: list[set[int]] = []
        starts, ends = [], []
        for glob in globs:
            starts.append(len(moves))
            moves.append(())
            keeps.append(set())
            for part in _parts(glob):
                if part == "**":
                    keeps[-1].update(range(256))
                elif part == "*":
                    keeps[-1].update(set(range(256)) - {_SLASH})
                elif part == "?":
                    # The first byte of a character; the others keep the bit where it is.
                    moves.append([b for b in range(256) if b != _SLASH and b not in _CONTINUED])
                    keeps.append(set(_CONTINUED))
                else:
                    moves.extend([byte] for byte in part)
                    keeps.extend(set() for _ in part)
            ends.append(len(moves) - 1)
        self.words = max(1, -(-len(moves) // 64))
        if self.words > MOST_WORDS:
            raise ValueError(f"the rules have {len(moves)} places; {64 * MOST_WORDS} can be held")
        self.move = self._table(moves)
        self.keep = self._table(keeps)
        self.begin = np.zeros(self.words, np.uint64)
        for at in starts:
            self.begin[at >> 6] |= np.uint64(1 << (at & 63))
        self.end = np.array(ends, np.int64)

    def _table(self, bytes_of: Sequence[Sequence[int] | set[int]]) -> np.ndarray:
        """A row of bits for each byte value."""
        bits = np.zeros((256, 64 * self.words), bool)
        for at, some in enumerate(bytes_of):
            bits[list(some), at] = True
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(np.uint64)

    @cached_property
    def _numbers(self) -> tuple[list[int], list[int]]:
        """The tables as whole numbers."""
        return tuple([int.from_bytes(row.astype("<u8").tobytes(), "little") for row in t] for t in (self.move, self.keep))

    def _rest(self, state: np.ndarray, text: bytes) -> np.ndarray:
        """The state after the bytes of one text."""
        move, keep = self._numbers
        now = int.from_bytes(state.astype("<u8").tobytes(), "little")
        for byte in text:
            now = now << 1 & move[byte] | now & keep[byte]
            if not now:
                break
        return np.frombuffer(now.to_bytes(8 * self.words, "little"), "<u8")

    def states(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bits left after each text has been read."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        starts, left = bounds[:-1][order], np.sort(lengths)
        state = np.tile(self.begin, (len(order), 1))
        step, top = 0, np.uint64(63)
        while (active := len(left) - int(np.searchsorted(left, step, "right"))) >= FEW:
            byte = data[starts[:active] + step]
            now = state[:active]
            up = now << np.uint64(1)
            up[:, 1:] |= now[:, :-1] >> top
            state[:active] = up & self.move[byte] | now & self.keep[byte]
            step += 1
        for i in range(active):
            begin, end = int(starts[i]) + step, int(starts[i] + lengths[order[i]])
            state[i] = self._rest(state[i], data[begin:end].tobytes())
        out = np.empty_like(state)
        out[order] = state
        return out

    def first(self, column: pa.Array) -> np.ndarray:
        """The number of the first glob that matches each whole text; the number of globs if none does."""
        data, bounds = flat(column)
        out = np.full(len(bounds) - 1, len(self.end))
        block = max(1, BLOCK_WORDS // max(self.words, len(self.end)))
        for a in range(0, len(out), block):
            some = bounds[a : a + block + 1]
            state = self.states(data, some)
            met = state[:, self.end >> 6] >> (self.end & 63).astype(np.uint64) & np.uint64(1)
            if len(self.end):
                out[a : a + block] = np.where(met.any(axis=1), met.argmax(axis=1), len(self.end))
        return out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = SITE_RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
    default: str = DEFAULT,
    id_column: str = "page_id",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``, which has an id and ``url``.

    A rule (verdict, host, path) fits its host and all its subdomains, if the path begins with the rule's. The
    longest one wins; of equally long ones that with the longer host, then the first. ``rule`` is its host
    and path, null where none fits. There the first glob (verdict, pattern) that matches the canonical
    URL decides, and ``default`` where none does. A url that is null, empty or without ``://`` has an empty host
    and path. Each URL is read whole, however long. Repeated rows and null ids give rows of their own; other columns,
    whatever their names, are not looked at; an empty table gives none. The rules are held by every
    task; more than a million places of them are refused.
    """
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    patterns, names, verdicts = [], [], []
    for verdict, host, path in ranked:
        # No part of a host holds a slash, so the wildcard stays in the host.
        for before in ("", "*."):
            patterns.append(before + quoted(host + path) + "**")
            names.append(host + path)
            verdicts.append(verdict)
    for verdict, glob in globs:
        patterns.append(glob)
        names.append(None)
        verdicts.append(verdict)
    automaton = Automaton(patterns)
    rule_of, verdict_of = pa.array([*names, None], pa.string()), pa.array([*verdicts, default], pa.string())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "whole"):
                which = pa.array(automaton.first(part.column("whole")))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], rule_of.take(which), verdict_of.take(which)],
                    [id_column, "host", "path", "rule", "verdict"],
                )

    split = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = split.schema[id_column].dataType.simpleString()
    whole = split.withColumn("whole", F.concat("host", "path"))
    return whole.mapInArrow(scan, f"`{id_column}` {kind}, host string, path string, rule string, verdict string")
