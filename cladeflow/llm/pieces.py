"""Segments: stretches of a text that a piece model encodes independently of each other."""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece
from sentencepiece import sentencepiece_model_pb2

MARK = "▁"
#: Segments kept by a worker; then it starts anew.
KEPT = 150_000
_SEGMENT = re.compile(" +[^ ]*")


class PieceModel:
    """A sentencepiece model with its settings, and whether white space is a safe boundary.

    It is safe if merges never cross it: the model is a BPE that keeps white space as it is,
    and no piece has the white space mark behind another character. A text is then encoded as
    the concatenation of its segments, each a run of blanks and the word behind it. The library
    puts a blank before what it encodes, so a segment is handed over without its first blank.
    """

    def __init__(self, path: str):
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalizer = proto.normalizer_spec
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.kinds = [p.type for p in proto.pieces]
        self.lengths = [1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces]
        n = self.normalizer
        self.plain = not n.precompiled_charsmap and not n.remove_extra_whitespaces and n.escape_whitespaces
        self.safe = (
            self.plain and n.add_dummy_prefix and self.byte_fallback
            and proto.trainer_spec.model_type == 2 and not proto.trainer_spec.treat_whitespace_as_suffix
            and all(p.type in (1, 2, 3, 6) for p in proto.pieces)
            and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        )
        lone = self.lib.encode("a ")[len(self.lib.encode("a")):]
        self._first = {"": (tuple(lone), ",".join(map(str, lone)))}
        self._known: dict[str, tuple] = dict(self._first)

    def segments(self, text: str) -> list[str]:
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = text.split(" ")
        return parts if all(parts) else [s[1:] for s in _SEGMENT.findall(" " + text)]

    def learn(self, segments) -> dict[str, tuple]:
        """The table of known segments, with the given ones in it: ids, and ids as text."""
        new = [s for s in set(segments) if s not in self._known]
        if new:
            if len(self._known) + len(new) > KEPT:
                self._known = dict(self._first)
                new = [s for s in set(segments) if s]
            for s, ids in zip(new, self.lib.encode(new, num_threads=1), strict=True):
                self._known[s] = (tuple(ids), ",".join(map(str, ids)))
        return self._known


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)
