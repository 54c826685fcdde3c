"""URL filter: rules, and for the rest a naive Bayes classifier over segmented host names and path tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import FOLD, LETTER, text_bytes
from .common import LOWER, UPPER, batch_rows, stored

#: Rules as (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Longest word that a host name is split into, in characters.
LONGEST = 24
#: Token features: hashes modulo this.
BUCKETS = 1 << 18
SMOOTHING = 0.1


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path; both empty for a null or a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written host + path, and its verdict; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict


def lexicon(texts: DataFrame) -> DataFrame:
    """(word, n): how often each word of letters stands in the texts, outside of tags; A-Z folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            if not len(data):
                continue
            place = np.arange(len(data))
            # within a tag: the last < is later than the last >, and in the same text
            opened = np.maximum.accumulate(np.where(data == ord("<"), place, -1))
            closed = np.maximum.accumulate(np.where(data == ord(">"), place, -1))
            inside = (opened > closed) & (opened >= np.repeat(at[:-1], np.diff(at)))
            plain = np.where(LETTER[data] & ~inside, FOLD[data], 32).astype(np.uint8)
            plain = np.insert(plain, at[1:-1], 32)  # texts do not run into each other
            text = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(plain)], np.int64)), pa.py_buffer(plain)])
            coded = pc.ascii_split_whitespace(text).flatten().dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    return texts.mapInArrow(run, "word string, n long").filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def split_names(names: DataFrame, words: DataFrame) -> DataFrame:
    """Segment every distinct ``name``: (name, words), the likeliest split by unigram probabilities (Viterbi).

    All substrings of the distinct names, up to ``LONGEST`` characters, meet the lexicon in one join, so the lexicon
    may be of any size. A piece that is no word has probability 10 / (N 10^length). Ties go to the split whose last
    word is the longest.
    """
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    size = F.length("name")
    at = names.select("name", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    piece = at.select("name", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - F.col("start") + 1))).alias("len"))
    piece = piece.withColumn("word", F.expr("substring(name, start, len)"))
    found = piece.join(words, "word").groupBy("name").agg(F.collect_list(F.struct("start", "len", "n")).alias("found"))
    rows = names.join(found, "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, hits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                known = {(h["start"] - 1, h["len"]): math.log(h["n"] / total) for h in hits or []}
                best, back = [0.0], [0]
                for end in range(1, len(name) + 1):
                    options = []
                    for n in range(1, min(LONGEST, end) + 1):
                        p = known.get((end - n, n), math.log(10 / total) - n * math.log(10))
                        options.append((best[end - n] + p, n))
                    top = max(options)
                    best.append(top[0])
                    back.append(top[1])
                split, end = [], len(name)
                while end:
                    split.append(name[end - back[end] : end])
                    end -= back[end]
                out.append(split[::-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["name", "words"])

    return rows.mapInArrow(run, "name string, words array<string>")


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def _names(host: Column) -> Column:
    """The runs of letters in a host name."""
    return F.filter(F.split(host, "[\\x00-\\x60\\x7b-\\x7f]+"), lambda x: x != "")


def path_tokens(path: Column) -> Column:
    parts = F.filter(F.split(F.translate(path, UPPER, LOWER), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.concat(F.lit("path "), F.when(x.rlike("^[0-9]+$"), F.lit("#")).otherwise(x)))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (log odds of block) for every row.

    A rule's verdict stands. All other urls get the classifier's: block if the log odds are above 0. The classifier learns
    from the urls that a rule decides: multinomial counts of the words in their host names, split by Viterbi with
    unigram counts of the pages' words, and of their path tokens (a run of digits is one token). Its counts cover all
    rows and are hashed to ``BUCKETS`` numbers, so what is broadcast is bounded. Hosts are split once each.

    A null url, or one without ``://``, has an empty host and path: no rule fits and the prior decides. Null page ids
    and texts are allowed; repeated rows are judged each. No rows in, no rows out; other columns are ignored.
    """
    spark = pages.sparkSession
    batch_rows(spark)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    host, path = url_parts(F.col("url"))
    parsed = plain.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = stored(parsed.withColumns({"rule": rule, "ruled": verdict}))

    words = stored(lexicon(pages.select(F.col(text_col).alias("text"))))
    hosts = stored(rows.groupBy("host").agg(F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("n_block"), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("n_allow")))
    labels = hosts.select("host", F.explode(_names(F.col("host"))).alias("name"))
    split = stored(split_names(labels.select("name").distinct(), words))
    tokens = stored(labels.join(split, "name").select("host", F.explode("words").alias("word")).select("host", _bucket(F.concat(F.lit("host "), F.col("word"))).alias("bucket")))

    by_host = tokens.join(hosts, "host").groupBy("bucket").agg(F.sum("n_block").alias("b"), F.sum("n_allow").alias("a"))
    ruled = rows.filter("ruled is not null").select("ruled", F.explode(path_tokens(F.col("path"))).alias("token"))
    by_path = ruled.groupBy(_bucket(F.col("token")).alias("bucket")).agg(F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("b"), F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("a"))
    counts = by_host.unionByName(by_path).groupBy("bucket").agg(F.sum("b").alias("b"), F.sum("a").alias("a")).filter("a + b > 0")
    n_block, n_allow = hosts.agg(F.coalesce(F.sum("n_block"), F.lit(0)), F.coalesce(F.sum("n_allow"), F.lit(0))).first()
    model = np.zeros((BUCKETS, 2))
    for r in counts.collect():  # at most BUCKETS rows
        model[r["bucket"]] = r["b"], r["a"]
    sums, seen = model.sum(axis=0), max(int((model.sum(axis=1) > 0).sum()), 1)
    odds = np.log((model[:, 0] + SMOOTHING) / (sums[0] + SMOOTHING * seen)) - np.log((model[:, 1] + SMOOTHING) / (sums[1] + SMOOTHING * seen))
    odds[model.sum(axis=1) == 0] = 0.0  # a token that was never seen tells nothing
    prior = math.log((n_block + 1) / (n_allow + 1))
    shared = spark.sparkContext.broadcast(odds)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            n = np.diff(lists.offsets.to_numpy())
            value = np.bincount(np.repeat(np.arange(b.num_rows), n), weights=shared.value[lists.flatten().to_numpy(zero_copy_only=False)], minlength=b.num_rows).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(value)], names=[*b.schema.names[:-1], "odds"])

    host_lists = hosts.select("host").join(tokens.groupBy("host").agg(F.collect_list("bucket").alias("buckets")), "host", "left")
    host_odds = host_lists.select("host", F.coalesce("buckets", F.array().cast("array<int>")).alias("buckets")).mapInArrow(scored, "host string, odds double")
    path_lists = rows.select("page_id", "host", "path", "rule", "ruled", F.transform(path_tokens(F.col("path")), _bucket).alias("buckets"))
    paths = path_lists.mapInArrow(scored, "page_id long, host string, path string, rule string, ruled string, odds double")
    both = paths.join(host_odds.withColumnRenamed("odds", "host_odds"), "host")
    score = F.lit(prior) + F.col("odds") + F.col("host_odds")
    return both.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
