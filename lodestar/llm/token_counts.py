"""Token counts by the whole-token shortcut.

A sentencepiece BPE model whose pieces never hold a space mark behind another character, and never a line feed, can
merge nothing across these places. So a text falls into pre-tokens (a run of space marks and what follows, parted at
line feeds) that encode on their own. proof() checks both properties of the vocabulary and lists the vocabulary strings
that the library itself encodes alone as one token. It runs offline: once on the driver, before any text is read; its
table goes to the workers with the digest of the model file that it holds for, and a worker with another file makes its
own. Pre-tokens in the table count as one without merging; the rest is merged by the library, each distinct one once for
a slice. Where the proof fails, every text goes to the library as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, free_name, slices

MARK = "▁"
#: Merged pre-tokens that a worker remembers; then it forgets them all. It bounds memory and changes no count.
REMEMBERED = 1 << 18
MODEL = "piece_bpe_32k.model"
PRETOKEN = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


def model_path(name: str = MODEL) -> str:
    """Where this machine has the tokenizer file; each worker asks for its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@functools.cache
def proof(path: str) -> tuple[str, tuple | None]:
    """The digest of a model file, and what prove() says of it."""
    return digest(path), Counting(path).proved


class Counting:
    """Token counts of texts under one model, without begin, end or added special tokens.

    proved: what prove() found for this very model; made anew where it isn't given.
    """

    def __init__(self, path: str, proved: tuple | None | bool = False):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.known: dict[str, int] = {}
        self.proved = self.prove() if proved is False else proved
        self.whole, self.opening, self.bare = self.proved or (None, [], [])

    def alone(self, pretoken: str) -> list[int]:
        """The tokens of a pre-token that stands within a text."""
        if pretoken[0] == MARK:
            return self.model.encode(pretoken[1:]) if len(pretoken) > 1 else self.bare
        return self.model.encode("\n" + pretoken)[len(self.opening) :]

    def prove(self) -> tuple[frozenset[str], list[int], list[int]] | None:
        """The strings that encode alone as one token, and the tokens of a line feed and of a bare space mark in front.

        None if pre-tokens of this model don't encode on their own.
        """
        normal = self.model.encode("a  b\n ſ", out_type=str)
        inner = re.compile(f"[^{MARK}]{MARK}")
        if any(inner.search(p) or "\n" in p for p in self.pieces) or "".join(normal).replace("<0x0A>", "\n") != f"{MARK}a{MARK}{MARK}b\n ſ":
            return None
        opening = self.model.encode("\n")
        if self.model.encode("\n\n")[: len(opening)] != opening:
            return None
        own = [p for i, p in enumerate(self.pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)) and PRETOKEN.fullmatch(p) and p != MARK]
        marked, plain = [p for p in own if p[0] == MARK], [p for p in own if p[0] != MARK]
        ones = [p for p, ids in zip(marked, self.model.encode([p[1:] for p in marked], num_threads=1), strict=True) if len(ids) == 1]
        rest = self.model.encode(["\n" + p for p in plain], num_threads=1)
        return frozenset(ones + [p for p, ids in zip(plain, rest, strict=True) if len(ids) == len(opening) + 1] + [MARK, "\n"]), opening, opening[:1]

    def counts(self, texts: list[str]) -> list[int]:
        if self.whole is None:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        out = []
        whole, known = self.whole, self.known
        if len(known) > REMEMBERED:
            known.clear()
        for t in texts:
            n = 0
            for pretoken, times in Counter(PRETOKEN.findall(MARK + t.replace(" ", MARK)) if t else ()).items():
                if pretoken in whole:
                    n += times
                else:
                    if (k := known.get(pretoken)) is None:
                        k = known[pretoken] = len(self.alone(pretoken))
                    n += k * times
            out.append(n)
        return out


_COUNTING: dict[str, Counting] = {}


def counting(path: str, proved: tuple[str, tuple | None]) -> Counting:
    """One model in memory for each worker and path, with the driver's proof where the file is the same."""
    if path not in _COUNTING:
        _COUNTING[path] = Counting(path, proved[1]) if digest(path) == proved[0] else Counting(path)
    return _COUNTING[path]


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: str = MODEL, out: str = "n_tokens") -> DataFrame:
    """The columns keep (default: all) of df and the long `out`: tokens of the whole text.

    Null counts as the empty text, which has 0 tokens. Strings like </s> inside a text are ordinary text. Where df has a
    column `out`, an underscore is put in front of the new one. Rows keep their number, repeated ones too.
    """
    keep = df.columns if keep is None else keep
    name, hidden = free_name(df, out), free_name(df, "text_to_count")
    given = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    schema = given.drop(hidden).withColumn(name, F.lit(0).cast("long")).schema

    table = proof(model_path(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, hidden):
                texts = pc.fill_null(binary(part[hidden]), b"").cast(pa.large_string()).to_pylist()
                yield pa.RecordBatch.from_arrays([part[c] for c in keep] + [pa.array(counting(model_path(model), table).counts(texts), pa.int64())], names=[*keep, name])

    return given.mapInArrow(run, schema)
