"""Minimal acyclic transducers from byte strings to their places in byte order."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

Arcs = tuple[tuple[int, int], ...]


class States:
    """A register of states (final, arcs): equal ones are one, so that what is built from it is minimal. Arcs are (byte, state), in the order of bytes."""

    def __init__(self) -> None:
        self.number: dict[tuple[bool, Arcs], int] = {}
        self.all: list[tuple[bool, Arcs]] = []

    def of(self, final: bool, arcs: Arcs) -> int:
        key = (final, arcs)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.all)
            self.all.append(key)
        return found

    def added(self, terms: Iterable[bytes]) -> int:
        """The first state of an automaton of `terms`, which come in byte order, each once: a state is registered as soon as no later term can change it."""
        path: list[tuple[list[bool], list[tuple[int, int]]]] = [([False], [])]
        last = b""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, arcs = path.pop()
                path[-1][1].append((last[len(path) - 1], self.of(final[0], tuple(arcs))))

        for term in terms:
            same, most = 0, min(len(last), len(term))
            while same < most and last[same] == term[same]:
                same += 1
            close(same)
            path.extend(([False], []) for _ in term[same:])
            path[-1][0][0] = True
            last = term
        close(0)
        return self.of(path[0][0][0], tuple(path[0][1]))

    def union(self, a: int, b: int) -> int:
        """A state that accepts what a or b does. Only states that both reach on one path are made anew."""
        if a == b:
            return a
        (final_a, arcs_a), (final_b, arcs_b) = self.all[a], self.all[b]
        arcs = dict(arcs_a)
        for byte, to in arcs_b:
            arcs[byte] = self.union(arcs[byte], to) if byte in arcs else to
        return self.of(final_a or final_b, tuple(sorted(arcs.items())))

    def reached(self, first: int) -> list[int]:
        """The states that can be reached from first; targets before those that lead to them."""
        seen, todo = {first}, [first]
        while todo:
            for _, to in self.all[todo.pop()][1]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return sorted(seen)  # a state is registered after its targets


@dataclass(frozen=True)
class Transducer:
    """Arcs by (state, byte) with what each adds to the place of a term; the last state is the first of a walk."""

    final: np.ndarray  # by state
    key: np.ndarray  # 256 * state + byte, ascending
    to: np.ndarray
    adds: np.ndarray

    @classmethod
    def of(cls, states: States, first: int) -> Transducer:
        order = states.reached(first)
        at = {s: k for k, s in enumerate(order)}
        final = np.array([states.all[s][0] for s in order], dtype=bool)
        below = [0] * len(order)  # terms that can be accepted from a state
        key, to, adds = [], [], []
        for k, s in enumerate(order):
            n = int(final[k])
            for byte, target in states.all[s][1]:
                key.append(256 * k + byte)
                to.append(at[target])
                adds.append(n)
                n += below[at[target]]
            below[k] = n
        return cls(final, np.array(key, dtype=np.int64), np.array(to, dtype=np.int32), np.array(adds, dtype=np.int64))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.final.tobytes(), self.key.tobytes(), self.to.tobytes()

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The places of the terms data[start:end]; -1 for one that isn't there. All walk in step, a byte at a time; who has no arc drops out."""
        n = len(start)
        state, place = np.full(n, len(self.final) - 1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if not len(self.key):
            return np.full(n, -1)
        live, at = np.arange(n), start.copy()
        while len(live):
            more = at < end[live]
            live, at = live[more], at[more]
            want = state[live] * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            goes = self.key[arc] == want
            state[live[~goes]] = -1
            live, at, arc = live[goes], at[goes] + 1, arc[goes]
            state[live] = self.to[arc]
            place[live] += self.adds[arc]
        return np.where((state >= 0) & self.final[state], place, -1)

    def terms(self) -> list[bytes]:
        """All terms in byte order."""
        arcs: dict[int, list[tuple[int, int]]] = {}
        for k, t in zip(self.key.tolist(), self.to.tolist()):
            arcs.setdefault(k >> 8, []).append((k & 255, t))
        out, todo = [], [(len(self.final) - 1, b"")]
        while todo:
            s, word = todo.pop()
            if self.final[s]:
                out.append(word)
            todo.extend((t, word + bytes([b])) for b, t in reversed(arcs.get(s, [])))
        return out


def unpacked(states: States, final: bytes, key: bytes, to: bytes) -> int:
    """The first state of a packed transducer, registered in states."""
    ends, keys, targets = np.frombuffer(final, bool), np.frombuffer(key, np.int64), np.frombuffer(to, np.int32)
    begin = np.searchsorted(keys >> 8, np.arange(len(ends) + 1)).tolist()
    byte, target = (keys & 255).tolist(), targets.tolist()
    number: list[int] = []
    for s, end in enumerate(ends.tolist()):
        number.append(states.of(end, tuple((byte[k], number[target[k]]) for k in range(begin[s], begin[s + 1]))))
    return number[-1]
