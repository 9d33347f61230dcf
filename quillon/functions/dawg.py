"""Packed word graphs: a header, then edges of 64 bits in runs, one run per node.

An edge holds a letter in its low bits, three flags (last of its run, backward, end of a word) and the
place of the run it leads to. A word's last letter may lead to place 0, which is no next run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from typing import NamedTuple

#: Fixed values of the format.
MAGIC, LAST, BACKWARD, ENDS = 42, 1, 2, 4
MOST_EDGES = 50_000_000


class Graph(NamedTuple):
    letters: int
    edges: Sequence[int]

    @property
    def flags_at(self) -> int:
        return self.letters.bit_length()

    def next_of(self, edge: int) -> int:
        return edge >> (self.flags_at + 3)

    def has(self, edge: int, flag: int) -> bool:
        return bool(edge >> self.flags_at & flag)

    @property
    def empty(self) -> int:
        """An edge that isn't in use."""
        return (1 << 64) - (1 << (self.flags_at + 3))


def pack(words: Iterable[Sequence[int]], letters: int) -> bytes:
    """The graph of words, letters below letters; equal endings share their runs."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, [False, {}])[1]
        if word:
            node_of(root, word)[0] = True
    graph, edges, placed = Graph(letters, []), [], {}

    def form(node: dict) -> tuple:
        return tuple((c, ends, form(after)) for c, (ends, after) in sorted(node.items()))

    # Runs are placed from the root on; what comes out equal is placed once.
    waiting = [form(root)]
    placed[waiting[0]] = 0
    size = len(waiting[0])
    for run in waiting:
        for _, _, after in run:
            if after and after not in placed:
                placed[after] = size
                size += len(after)
                waiting.append(after)
    for run in waiting:
        for i, (c, ends, after) in enumerate(run):
            flags = LAST * (i + 1 == len(run)) | ENDS * ends
            edges.append(c | flags << graph.flags_at | (placed[after] if after else 0) << (graph.flags_at + 3))
    return struct.pack("<HII", MAGIC, letters, len(edges)) + struct.pack(f"<{len(edges)}Q", *edges)


def node_of(root: dict, word: Sequence[int]) -> list:
    node = root
    for c in word[:-1]:
        node = node[c][1]
    return node[word[-1]]


def parse(data: bytes) -> Graph:
    """Reads a graph; raises ValueError for a bad header, edges that lead outside and runs without a last edge."""
    if len(data) < 10:
        raise ValueError("the header is cut short")
    magic, letters, n = struct.unpack_from("<HII", data)
    if magic != MAGIC or letters == 0 or letters.bit_length() + 3 >= 64:
        raise ValueError("no header of a word graph")
    if not 0 < n <= min(MOST_EDGES, (len(data) - 10) // 8):
        raise ValueError("a number of edges that the data doesn't hold")
    graph = Graph(letters, struct.unpack_from(f"<{n}Q", data, 10))
    closed = False  # whether the run that goes on from here has a last edge
    for edge in reversed(graph.edges):
        if edge == graph.empty:
            closed = False
            continue
        if graph.next_of(edge) >= n:
            raise ValueError("an edge leads outside")
        if graph.has(edge, BACKWARD):
            closed = False
        elif not (closed := closed or graph.has(edge, LAST)):
            raise ValueError("a run without a last edge")
    return graph


def matches(graph: Graph, word: Sequence[int], whole: bool) -> bool:
    """Whether word is in the graph, or begins a word of it."""
    if not word:
        return not whole
    at, mask = 0, (1 << graph.flags_at) - 1
    for i, c in enumerate(word):
        while True:
            edge = graph.edges[at] if at < len(graph.edges) else graph.empty
            if edge == graph.empty or graph.has(edge, BACKWARD):
                return False
            if edge & mask == c:
                break
            if graph.has(edge, LAST):
                return False
            at += 1
        if i + 1 == len(word):
            return not whole or graph.has(edge, ENDS)
        at = graph.next_of(edge)
        if at == 0:
            return False
    return False
