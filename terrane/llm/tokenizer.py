"""Encoding of a corpus with a public byte-level BPE tokenizer, in Spark's own expressions.

A text is cut into words by the tokenizer's pattern. The rank of every mergeable byte string is a literal map; a
word's ids come from folding the ranked merges over its bytes. The corpus' frequent words are folded once and become
a second literal map of bounded size; every other word is folded where it stands. Neither map changes a result, so
there is no vocabulary join, no shuffle of texts and no limit on words. Decoding concatenates the pieces' bytes.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.text import let
from terrane.session import cut

#: Folder of the public vocabulary files.
FOLDER = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: White space as the pattern means it (Unicode's White_Space), spelled out since \s is ASCII only in Java. Fixed values.
_S = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The tokenizer's pattern, the most frequent kind of word first and without backtracking where it can't help. Fixed value.
PATTERN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:[stmd]|re|ve|ll)| ?[^{_S}\p{{L}}\p{{N}}]++|[{_S}]+(?![^{_S}])|[{_S}]+"
#: The maps' buckets, and the bounds of the map of frequent words: at most this many words of at most so many characters.
BUCKETS, HOT_WORDS, HOT_CHARS = 1 << 15, 40_000, 512
#: Classes of a word's count per doubling, of which one is the limit of frequent words; tasks that fold them.
BANDS, FOLD_TASKS = 8, 24
_NONE = 2**31 - 1


def load_ranks(name: str = BYTE_BPE, folder: str = FOLDER) -> dict[bytes, int]:
    """The mergeable byte strings and their ids, which are also their ranks."""
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """A power of two of buckets, by Spark's xxhash64: the same as the public algorithm with seed 42."""
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)).cast("int")


def word_bucket(word: Column) -> Column:
    """The cheaper 32-bit hash, for the map that every word of the corpus is looked up in."""
    return F.hash(word).bitwiseAND(F.lit(BUCKETS - 1))


def literal_map(rows: list[tuple[int, str, object]], kind: str, buckets: int = BUCKETS) -> Column:
    """A literal map from strings, as an array of buckets: Spark searches a map linearly, so each holds few keys.
    ``rows`` are (bucket, key, value). Catalyst folds the JSON into a literal when it plans."""
    parts: list[dict] = [{} for _ in range(buckets)]
    for b, k, v in rows:
        parts[b][k] = v
    return F.from_json(F.lit(json.dumps(parts, separators=(",", ":"))), f"array<map<string,{kind}>>")


def look_up(maps: Column, key: Column, at: Column | None = None) -> Column:
    return F.try_element_at(F.get(maps, bucket(key) if at is None else at), key)


@dataclass(frozen=True)
class Tokenizer:
    ranks: Column  # literal map from hexadecimal byte strings to ids
    hot: Column | None = None  # literal map from frequent words to ids

    @classmethod
    def load(cls, spark, name: str = BYTE_BPE, folder: str = FOLDER) -> Tokenizer:
        ranks = load_ranks(name, folder)
        import xxhash

        return cls(literal_map([(xxhash.xxh64_intdigest(k.hex().upper().encode(), seed=42) % BUCKETS, k.hex().upper(), v) for k, v in ranks.items()], "int"))

    def words(self, text: Column) -> Column:
        return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))

    def bound(self, body) -> Column:
        """``body(ranks, hot)`` with each literal map standing in the plan once, however often the body uses it."""
        if self.hot is None:
            return let(self.ranks, lambda r: body(r, None))
        return let(self.ranks, lambda r: let(self.hot, lambda h: body(r, h)))

    def fold(self, word: Column, ranks: Column) -> Column:
        """The ids of one word: merges of least rank first, the leftmost of equals, until none is left."""

        def merged(h: Column) -> Column:
            rank = lambda a, b: F.coalesce(look_up(ranks, h.substr(2 * a + 1, 2 * (b - a))), F.lit(_NONE))
            n = (F.length(h) / 2).cast("int")
            at = F.sequence(F.lit(0), n)
            # starts: where each token begins, and the end; pairs: rank of each token with its right neighbour
            begin = F.struct(at.alias("starts"), F.transform(F.slice(at, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda i: rank(i, i + 2)).alias("pairs"))

            def step(s: Column, _: Column) -> Column:
                starts, pairs = s["starts"], s["pairs"]

                def merge(i: Column) -> Column:  # pair i (from 1) becomes one token
                    g = lambda k: F.get(starts, k)
                    left = F.when(i > 1, F.array(rank(g(i - 2), g(i + 1)))).otherwise(F.array().cast("array<int>"))
                    right = F.when(i < F.size(pairs), F.array(rank(g(i - 1), g(i + 2)))).otherwise(F.array().cast("array<int>"))
                    rest = lambda a, k: F.slice(a, k, F.greatest(F.size(a) - k + 1, F.lit(0)))
                    return F.struct(
                        F.concat(F.slice(starts, F.lit(1), i), rest(starts, i + 2)).alias("starts"),
                        F.concat(F.slice(pairs, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, rest(pairs, i + 2)).alias("pairs"),
                    )

                return let(F.array_min(pairs), lambda m: F.when(m.isNull() | (m == _NONE), s).otherwise(let(F.array_position(pairs, m).cast("int"), merge)))

            ids = lambda s: F.transform(F.slice(s["starts"], F.lit(1), F.size(s["starts"]) - 1), lambda a, k: look_up(ranks, h.substr(2 * a + 1, 2 * (F.get(s["starts"], k + 1) - a))))
            whole = look_up(ranks, h)
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.aggregate(F.sequence(F.lit(2), n), begin, step, ids))

        return let(F.hex(F.encode(word, "utf-8")), merged)

    def word_ids(self, word: Column, ranks: Column, hot: Column | None) -> Column:
        return self.fold(word, ranks) if hot is None else F.coalesce(look_up(hot, word, word_bucket(word)), self.fold(word, ranks))

    def encode(self, text: Column) -> Column:
        """The list of ids of a text; an empty list for '' and for NULL."""
        return self.bound(lambda r, h: F.flatten(F.transform(self.words(text), lambda w: self.word_ids(w, r, h))))

    def length(self, text: Column) -> Column:
        """The number of ids of a text; 0 for '' and for NULL."""
        return self.bound(lambda r, h: F.aggregate(self.words(text), F.lit(0), lambda n, w: n + F.size(self.word_ids(w, r, h))))

    def fitted(self, texts: DataFrame, column: str, hot_words: int = HOT_WORDS) -> Tokenizer:
        """The same tokenizer with a map of the corpus' most frequent words, at most ``hot_words`` of them.

        Words are counted over all texts with map-side aggregation. A histogram of the counts, by classes of the
        logarithm and so of some hundred rows whatever the corpus, gives the least count whose words are few enough;
        these are folded once each on the executors, and only they reach the driver. The map is a store, not a
        vocabulary: what it lacks (words of one occurrence among them) is folded where it stands, with equal results.
        """
        words = texts.select(F.explode(self.words(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        counts = cut(words.where((F.col("n") > 1) & (F.length("word") <= HOT_CHARS)).withColumn("band", F.floor(F.log2("n") * BANDS)))
        least, total = None, 0
        for r in sorted(counts.groupBy("band").agg(F.count("*").alias("words")).collect(), reverse=True):
            total += r["words"]
            if total > hot_words:
                break
            least = r["band"]
        top = counts.where(F.col("band") >= F.lit(least).cast("long")).repartition(FOLD_TASKS, "word")
        rows = top.select(word_bucket(F.col("word")).alias("b"), "word", let(self.ranks, lambda r: self.fold(F.col("word"), r)).alias("ids")).collect()
        return Tokenizer(self.ranks, literal_map([(r["b"], r["word"], r["ids"]) for r in rows], "array<int>"))


def decode(ids: Column, pieces: Column) -> Column:
    """The text of a list of ids, given the literal array of hexadecimal pieces; bytes that are no UTF-8 are replaced."""
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "utf-8")


def literal_pieces(ranks: dict[bytes, int]) -> Column:
    """Literal array of each id's bytes in hexadecimal."""
    out = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        out[v] = k.hex().upper()
    return F.split(F.lit(",".join(out)), ",")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: Tokenizer | None = None) -> DataFrame:
    """(key, ids) of every row; repeated rows stay, NULL and '' give an empty list, other columns play no part."""
    t = (tokenizer or Tokenizer.load(docs.sparkSession)).fitted(docs, text)
    return docs.select(key, t.encode(F.col(text)).alias("ids"))
