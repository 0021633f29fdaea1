"""Encoders: ids of a byte-level BPE and numbers of tokens of a sentencepiece model."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

#: Byte budget of one call to an encoder, and the length beyond which a text is cut into parts for it.
BATCH_BYTES = 1 << 20
LONG = 1 << 16

#: Characters on which the rules for pre-tokens of both BPE libraries surely agree: Latin, Greek, Cyrillic and common signs.
_PLAIN = re.compile("[\\n -~À-ÖØ-öø-ɏΑ-Ωα-ωА-я–—‘’“”…€]*")


class ByteBpe:
    """Ids equal to those of the tokenizers library with its defaults and add_special_tokens=False: strings of added tokens inside texts become those tokens.

    Texts of common letters without such strings go through the rank file of the same vocabulary, several times faster; all others through
    the library itself.
    """

    def __init__(self, library: str | None = None, ranks: str | None = None) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(library or public_tokenizers.path("byte_bpe_50k.json"))
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids."""
        if not text:
            return np.empty(0, np.uint32)
        if _PLAIN.fullmatch(text) and not any(t in text for t in self.added):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def parts(text: str, limit: int = LONG) -> Iterator[str]:
    """Cuts a long text at single spaces between other characters, leaving each such space out.

    A model that starts every text with the space mark gives the following part the mark that the space would have been,
    so counts add up. Without such a place the text stays whole.
    """
    at = 0
    while len(text) - at > limit:
        to = text.rfind(" ", at + 1, at + limit)
        while to > at and (text[to - 1] in " ▁" or text[to + 1] in " ▁"):
            to = text.rfind(" ", at + 1, to)
        if to <= at:
            to = text.find(" ", at + limit)
            while 0 <= to and (to + 1 >= len(text) or text[to - 1] in " ▁" or text[to + 1] in " ▁"):
                to = text.find(" ", to + 1)
            if to < 0:
                break
        yield text[at:to]
        at = to + 1
    yield text[at:]


class PieceCount:
    """Numbers of tokens of a sentencepiece model.

    Long texts are cut only if no piece of the model holds the space mark after another character and spaces stay as they are.
    Parts of like size are encoded together, and a call gets about BATCH_BYTES of UTF-8 however many parts those are.
    """

    def __init__(self, model: str | None = None, limit: int = LONG) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.limit = limit if not any("▁" in p.lstrip("▁") for p in pieces) and self.model.normalize("a  b ") == "▁a▁▁b▁" else 1 << 62

    def counts(self, texts: list[str | None]) -> list[int]:
        """Of each text; calls of the encoder get about as many bytes each."""
        out, cut = [0] * len(texts), []
        for i, t in enumerate(texts):
            cut += [(len(p.encode("utf-8", "surrogatepass")), i, p) for p in parts(t or "", self.limit)]
        cut.sort(key=lambda x: x[0])
        size, kept = 0, []
        for k, (n, i, p) in enumerate(cut):
            kept.append((i, p))
            size += n
            if size >= BATCH_BYTES or k == len(cut) - 1:
                for (j, _), ids in zip(kept, self.model.encode([x for _, x in kept], num_threads=1), strict=True):
                    out[j] += len(ids)
                size, kept = 0, []
        return out
