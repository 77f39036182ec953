"""Token ids of the word tokenizer, remembered by chunk.

Its normaliser and its splitting pattern work on each run of text without ASCII white space by itself, and its
special strings hold no white space. So the ids of a text are those of its chunks in order, and each distinct
chunk goes to the library once while the worker remembers it. There it goes in one text with others, as a text of
many costs less than many texts: a chunk with one id of its own, MARK, stands between them and tells them apart. Chunks
that hold it go to the library one by one, as all of a text do that has more of its id than marks.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

from .common import Memo

#: What stands between chunks in a text for the library; chunks in such a text; chunks handed over at once.
MARK, TOGETHER, AT_ONCE = b"\x01", 64, 20_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.memo = Memo()
        own = self.library.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = own[0] if len(own) == 1 else None

    def encode(self, data: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast([x.decode("utf-8", "replace") for x in data], add_special_tokens=False)]

    def learn(self, chunks: list[bytes]) -> None:
        """Puts the ids of these chunks into the memo."""
        plain = [x for x in chunks if MARK not in x] if self.mark is not None else []
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        groups += [[x] for x in (set(chunks).difference(plain) if len(plain) < len(chunks) else ())]
        for group, ids in zip(groups, self.encode([(b"\n" + MARK + b"\n").join(x) for x in groups]), strict=True):
            found = np.array(ids, "<u4")
            cuts, held = np.flatnonzero(found == self.mark), found.tobytes()
            if len(group) == 1:
                parts = [held]
            elif len(cuts) == len(group) - 1:
                start = (np.append(0, cuts + 1) * 4).tolist()
                end = (np.append(cuts, len(found)) * 4).tolist()
                parts = [held[a:b] for a, b in zip(start, end, strict=True)]
            else:
                parts = [array("I", x).tobytes() for x in self.encode(group)]
            for chunk, part in zip(group, parts, strict=True):
                self.memo.put(chunk, part)

    def ids(self, data: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [x.split() for x in data]
        new = self.memo.missing(set().union(*split))
        for at in range(0, len(new), AT_ONCE):
            self.learn(new[at : at + AT_ONCE])
        get = self.memo.young.__getitem__
        return [b"".join(map(get, x)) for x in split]


_made: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per worker process and vocabulary."""
    if path not in _made:
        _made[path] = ChunkTokenizer(path)
    return _made[path]
