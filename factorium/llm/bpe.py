"""BPE encoding and decoding with a transducer of frequent words.

The corpus is counted once; its most frequent words, with their ids, become a minimal acyclic transducer
(lexicon.py) that the executors map into memory. A word that isn't in it is merged exactly, by rank. Texts of
plain Latin letters are split here; any other text goes through the vocabulary file's own normalizer and
splitter, so that every rule of Unicode is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, materialize, scratch, table, texts_in_pieces

VOCABULARY = "word_bpe_49k.json"
#: Words that the transducer holds at most.
FREQUENT = 65_536
#: Occurrences that a word of the transducer has at least.
LEAST = 3
#: Distinct words that a task remembers before it forgets them all, and words that a counting task holds.
REMEMBERED = 400_000

#: Letters up to which a word is merged by a plain list, and what stands for no rank.
SHORT, NO_RANK = 40, 1 << 62

#: Below U+0250 every character is composed already, and lower case is a matter of single characters.
PLAIN = re.compile(r"[^\x00-ɏ]")


def plain_words() -> re.Pattern:
    """The splitter's pattern for lower-cased plain texts, with the letters and numbers that can occur spelled out."""
    kinds = {c: unicodedata.category(c)[0] for c in sorted({c for i in range(0x250) for c in chr(i) + chr(i).lower()})}
    letters, numbers = ("".join(re.escape(c) for c, k in kinds.items() if k == kind) for kind in "LN")
    # The pattern in the vocabulary file, and the white space that its normalizer makes one blank.
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t\n\x0b\x0c\r\x20\x85\xa0{letters}{numbers}]+")


WORDS = plain_words()


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Exact BPE with a suffix at the end of a word."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        # The same by ids, for short words: a pair's rank and, in the lower bits, the id that it becomes.
        self.bits = max(self.vocab.values(), default=0).bit_length()
        self.joined = {(self.vocab[a], self.vocab[b]): i << self.bits | self.vocab[a + b] for (a, b), i in self.ranks.items()}
        self.inner = [self.vocab.get(c) for c in self.letters]
        self.final = [self.vocab.get(c + self.suffix) for c in self.letters]
        self.written = {i: t.encode() + b" " for i, t in self.tokens.items()}

    def merge(self, word: str) -> list[int]:
        """The ids of a word that is not empty: again and again the leftmost pair of the lowest rank becomes one."""
        spelled = word.encode()
        if len(spelled) > SHORT:
            parts = [self.letters[b] for b in spelled]
            parts[-1] += self.suffix
            return self.merge_long(parts)
        inner, get = self.inner, self.joined.get
        ids = [inner[b] for b in spelled]
        ids[-1] = self.final[spelled[-1]]
        lower = (1 << self.bits) - 1
        found = [get(p, NO_RANK) for p in zip(ids, ids[1:])]
        while found:
            least = min(found)
            if least == NO_RANK:
                break
            i = found.index(least)
            ids[i] = new = least & lower
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = get((new, ids[i + 1]), NO_RANK)
            if i:
                found[i - 1] = get((ids[i - 1], new), NO_RANK)
        return ids

    def merge_long(self, parts: list[str | None]) -> list[int]:
        """The same by a heap of pairs over a linked list: n log n in the word's length."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [self.vocab[p] for p in parts if p is not None]


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


@lru_cache(2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split(text: str, path: str) -> list[str]:
    """The words of a text without special tokens, before the bytes are spelled as letters."""
    if PLAIN.search(text) is None:
        return WORDS.findall(text.lower())
    tok = library(path)
    letters = {c: b for b, c in enumerate(byte_letters())}
    return [bytes([letters[c] for c in w]).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]


def pieces(text: str, path: str) -> Iterator[list[str] | int]:
    """Words between special tokens, and the special tokens' ids."""
    special = merger(path).special
    if not any(s in text for s in special):
        yield split(text, path)
        return
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        if part in special:
            yield special[part]
        elif part:
            yield split(part, path)


def count_words(docs: DataFrame, path: str, name: str) -> DataFrame:
    """(word, n) over all texts: counted in the task as far as memory allows, then summed. `name` finds the vocabulary file on an executor."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
        at, counts = local(name), Counter()
        for b in texts_in_pieces(batches, "text"):
            for t in b.column("text").to_pylist():
                for part in pieces(t or "", at):
                    if not isinstance(part, int):
                        counts.update(part)
            if len(counts) > REMEMBERED:
                yield batch(schema, word=list(counts.keys()), n=list(counts.values()))
                counts = Counter()
        yield batch(schema, word=list(counts.keys()), n=list(counts.values()))

    return docs.select("text").mapInArrow(rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def local(name: str) -> str:
    return SparkFiles.get(name)


def ship(spark: SparkSession, content: bytes, name: str) -> str:
    """Puts a file into the shared folder and has Spark bring it to every executor; its name there."""
    digest = hashlib.sha256(content).hexdigest()[:24]
    base = f"{digest}-{name}"
    path = f"{scratch(spark, 'file')}/{base}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(content))
    out.close()
    if not any(f.endswith("/" + base) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(path)
    return base


def frequent_words(docs: DataFrame, path: str, name: str, frequent: int = FREQUENT) -> list[str]:
    """At most `frequent` words: all that occur at least as often as a bound that a histogram of the counts gives. Only the histogram and the words above the bound come to the driver."""
    counts = materialize(count_words(docs, path, name).where(F.col("n") >= LEAST).withColumn("bin", F.floor(F.log2("n") * 8).cast("int")), "words")
    total, bound = 0, None
    for r in sorted(counts.groupBy("bin").agg(F.count("*").alias("words")).collect(), key=lambda r: -r.bin):
        total += r.words
        if total > frequent:
            break
        bound = r.bin
    return [] if bound is None else sorted(r.word for r in counts.where(F.col("bin") >= bound).select("word").toLocalIterator())


def build_lexicon(docs: DataFrame, path: str, name: str, frequent: int = FREQUENT) -> bytes:
    """The transducer of the corpus's most frequent words; an empty corpus gives an empty one."""
    from .lexicon import compile_lexicon

    m = merger(path)
    return compile_lexicon({w.encode(): m.merge(w) for w in frequent_words(docs, path, name, frequent) if w})


class Encoder:
    """Words to ids: the transducer first, exact merging for the rest."""

    def __init__(self, path: str, lexicon_path: str | None) -> None:
        from .lexicon import Lexicon

        self.path, self.merger = path, merger(path)
        self.lexicon = Lexicon.open(lexicon_path) if lexicon_path else None
        self.seen: dict[str, tuple[bytes, int, bytes]] = {}

    def ids(self, word: str) -> list[int]:
        found = self.lexicon.get(word.encode()) if self.lexicon else None
        return self.merger.merge(word) if found is None else found

    def word(self, word: str) -> tuple[bytes, int, bytes]:
        """Packed ids, how many, and their tokens with a blank after each."""
        if (out := self.seen.get(word)) is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            out = self.pack(self.ids(word))
            if len(word) <= 64:
                self.seen[word] = out
        return out

    def pack(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        return struct.pack(f"<{len(ids)}I", *ids), len(ids), b"".join(map(self.merger.written.__getitem__, ids))

    def encode(self, text: str | None) -> tuple[bytes, int, bytes]:
        """Packed ids, how many, and the decoded text."""
        got: list[tuple[bytes, int, bytes]] = []
        word = self.word
        for part in pieces(text or "", self.path):
            if isinstance(part, int):
                got.append(self.pack([part]))
            else:
                seen = self.seen.get
                got += [seen(w) or word(w) for w in part]
        return b"".join([g[0] for g in got]), sum([g[1] for g in got]), b"".join([g[2] for g in got])[:-1]


def decode(ids: list[int], path: str) -> str:
    """The file names no decoder: the library then joins tokens by a blank, special ones too; unknown ids are passed over."""
    tokens = merger(path).tokens
    return " ".join([tokens[i] for i in ids if i in tokens])


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, vocabulary: str | None = None, frequent: int = FREQUENT, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (with keep: ids as packed little-endian 32-bit integers and decoded) of each row.

    A null text is empty: no ids, an empty decoded text. Texts are whole; a very long word costs n log n. Repeated
    rows are each encoded; other columns are ignored.
    """
    spark = docs.sparkSession
    path = vocabulary or vocabulary_path()
    with open(path, "rb") as f:
        name = ship(spark, f.read(), "vocabulary.json")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lexicon = ship(spark, build_lexicon(rows, path, name, frequent), "lexicon.bin")
    schema = pa.schema([*ENCODED, ("ids", pa.binary()), ("decoded", pa.string())]) if keep else ENCODED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(local(name), local(lexicon))
        for b in texts_in_pieces(batches, "text"):
            got = [encoder.encode(t) for t in b.column("text").to_pylist()]
            more = {"ids": [g[0] for g in got], "decoded": [g[2].decode() for g in got]} if keep else {}
            yield batch(schema, doc_id=b.column("doc_id"), n_tokens=[g[1] for g in got], ids_sha256=[hashlib.sha256(g[0]).hexdigest() for g in got], decoded_sha256=[hashlib.sha256(g[2]).hexdigest() for g in got], **more)

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else ""))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
