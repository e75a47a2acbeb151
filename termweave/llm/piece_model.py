"""The parts of a SentencePiece model file that encoding and decoding need."""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]]  # piece, score, type; the position is the id
    kind: int
    dummy_prefix: bool

    @classmethod
    def load(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, kind, dummy, squeeze, escape, chars = [], UNIGRAM, True, True, True, b""
        for number, value in _fields(data):
            if number == 1:
                piece, score, of = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        of = v
                pieces.append((piece, score, of))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                chars, dummy, squeeze, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if kind not in (UNIGRAM, BPE) or chars or squeeze or not escape or any(t in (USER, UNUSED) for _, _, t in pieces):
            raise ValueError("only unigram and BPE models that keep the text as it is are handled")
        return cls(pieces, kind, dummy)

    def as_unigram(self) -> PieceModel:
        """The same pieces as a model whose best path counts; scores are scaled so that their sums stay exact."""
        return replace(self, kind=UNIGRAM, pieces=[(p, max(s / 1024, -40.0), t) for p, s, t in self.pieces])

    @property
    def vocabulary(self) -> list[tuple[str, int, float]]:
        return [(p, i, s) for i, (p, s, t) in enumerate(self.pieces) if t == NORMAL]

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def bytes_ids(self) -> list[int] | None:
        """The id of each byte value, or None in a model without byte pieces."""
        found = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        return [found[b] for b in range(256)] if len(found) == 256 else None

    def ranked(self) -> tuple[list[tuple[str, int, int]], list[list[int]]]:
        """(piece, code, rank) of the pieces of several characters, the best score first, and what codes beyond the ids stand for.

        The code of a piece is its id.  For BPE models it is made sure that one pass over a text's pieces,
        ordered by rank, then place, then size, makes all merges: each piece must come out of merges of
        better ones, as it does where merges were learned in that order.  Pieces of one score are merged
        from the left; they are handled if they come last and are runs of one character.  Lengths missing
        among them are added, with a code of their own for the ids such a run gets.
        """
        wide = sorted((-s, i, p) for p, i, s in self.vocabulary if len(p) > 1)
        if self.kind != BPE:
            return [(p, i, 0) for _, i, p in wide], []
        tied = [x for x in wide if x[0] == wide[-1][0]]
        tied = tied if len(tied) > 1 else []
        single = wide[: len(wide) - len(tied)]
        if any(a[0] == b[0] for a, b in zip(single, single[1:])):
            raise ValueError("only the last pieces of a BPE model may have equal scores")
        out = [(p, i, r) for r, (_, i, p) in enumerate(single)]
        beyond: list[list[int]] = []
        if tied:
            runs = {len(p): i for _, i, p in tied}
            char, most = tied[0][2][0], max(runs)
            if len(runs) < len(tied) or any(set(p) != {char} for _, _, p in tied):
                raise ValueError("pieces of one score must be runs of one character")
            one = next((i for p, i, _ in self.vocabulary if p == char), self.unknown)
            for size in range(2, most + 1):
                if size not in runs:
                    beyond.append([runs.get(n, one) for n in self._merged_run(size, runs)])
                code = runs.get(size, len(self.pieces) + 0x110000 + len(beyond) - 1)
                out.append((char * size, code, len(single)))
            for n in range(2, 3 * most):
                parts = [most] * (n // most) + [n % most] * (n % most > 0)
                if [m for k in parts for m in (self._merged_run(k, runs) if k > 1 and k not in runs else [k])] != self._merged_run(n, runs):
                    raise ValueError("runs of one character aren't merged from the left")
        rank = {p: (r, len(p)) for p, _, r in out}
        for p, code, _ in out:
            spans = sorted((rank[p[i:j]][0], i, j) for i in range(len(p)) for j in range(i + 2, len(p) + 1) if p[i:j] in rank)
            ends = set(range(len(p) + 1))
            for _, i, j in spans:
                inner = ends.intersection(range(i + 1, j))
                if i in ends and j in ends and len(inner) == 1:
                    ends -= inner
            if len(ends) > 2:
                raise ValueError(f"no merges of better pieces make {p!r}")
        return out, beyond

    @staticmethod
    def _merged_run(n: int, runs: dict[int, int]) -> list[int]:
        """The parts of a run of n equal characters, merged one pair at a time from the left."""
        parts = [1] * n
        while True:
            at = next((i for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in runs), None)
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
