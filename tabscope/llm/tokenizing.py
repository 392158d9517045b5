"""Public tokenizers inside tasks.

Vocabulary files are read on the driver from a path that the caller may give, and sent to the tasks.
"""

from __future__ import annotations

import base64
import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"

_END = b"\xff"  # stands for the end of a word; no UTF-8 text holds it
_PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_CHUNKS = 400_000  # remembered chunks of a task


def vocabulary(name: str, path: str | None = None) -> str:
    """The text of a vocabulary file, from ``path`` or the installed public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_encoding(content: str) -> tiktoken.Encoding:
    """A byte-level encoding from the lines of a rank file."""
    import public_tokenizers

    lines = (line.split() for line in content.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
    return tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_of_char() -> dict[str, int]:
    """The visible characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """Ids of the word-end BPE, as little-endian unsigned 32-bit numbers.

    The tokenizer lower-cases, drops white space and never joins across it, so a text is the chain of
    its chunks between blanks, and a chunk seen before needs no work. A new chunk of plain Latin
    characters is cut into words as the tokenizer does and merged by rank; any other chunk goes
    through the tokenizers library.
    """

    def __init__(self, content: str):
        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        chars = _byte_of_char()
        ids: dict[bytes, int] = {}
        for token, number in json.loads(content)["model"]["vocab"].items():
            body = token.removesuffix("</w>") if len(token) > 4 else token
            ids[bytes(chars[c] for c in body) + (_END if body != token else b"")] = number
        # Single bytes first, then bytes that end a word, then merges in the order of training.
        order = sorted(ids, key=lambda t: (not (len(t) == 2 and t.endswith(_END)), ids[t]))
        ranks = {bytes([b]): b for b in range(256)}
        for token in order:
            ranks.setdefault(token, len(ranks))
        self.merge = tiktoken.Encoding(
            "words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={}
        )._core_bpe.encode_single_piece
        self.numbers = [ids.get(token) for token in ranks]
        self.seen: dict[str, bytes] = {"": b""}

    def chunk(self, chunk: str) -> bytes:
        if not _PLAIN.fullmatch(chunk):
            found = self.library.encode(chunk, add_special_tokens=False).ids
        else:
            found = [
                self.numbers[rank]
                for part in _PARTS.findall(chunk.lower())
                for rank in self.merge(part.encode() + _END)
            ]
        ids = array("I", found)
        if ids.itemsize != 4 or array("H", [1]).tobytes() != b"\x01\x00":
            return b"".join(i.to_bytes(4, "little") for i in found)
        return ids.tobytes()

    def ids(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        if len(self.seen) > _CHUNKS:
            self.seen = {"": b""}
        seen = self.seen
        for c in set(chunks).difference(seen):
            seen[c] = self.chunk(c)
        return b"".join(map(seen.__getitem__, chunks))
