"""Spelling variants: words of a vocabulary that one inserted, deleted or replaced code point turns
into each other, found by composing the minimised acceptor of the vocabulary with a one-edit
transducer and the acceptor again.

A state of the composition is (state of the left acceptor, edits made, state of the right one). As
long as no edit is made both acceptors have read the same, so the composition splits by what they
have read: after the beginning ``head`` it is in the initial state (head, 0, head), and every such
state is a partition of its own. Edits within the first symbols are left to partitions that are
closed on the other side: all their words end alike, in ``tail``, and the machines run over what
stands before it. A partition of too many words is split by one more symbol; the edits at just that
place then are closed partitions, which the alphabet bounds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize

HEAD = 3
PARTITION_WORDS = 20_000
RATIO = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Acceptor:
    """Minimal deterministic acceptor of sorted different strings, which it also numbers.

    ``arcs[q]`` has (target, number of accepted strings before it) by symbol, in order of symbols.
    """

    def __init__(self, strings: Iterable[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            found = known.get(key)
            if found is None:
                found = known[key] = len(self.arcs)
                arcs, before = {}, int(node[0])
                for symbol, target in node[1]:
                    arcs[symbol] = (target, before)
                    before += self.count[target]
                self.arcs.append(arcs)
                self.final.append(node[0])
                self.count.append(before)
            return found

        path, last = [[False, []]], ""
        for string in strings:
            same = 0
            for a, b in zip(last, string, strict=False):
                if a != b:
                    break
                same += 1
            for i in range(len(last), same, -1):
                path[i - 1][1].append((last[i - 1], freeze(path.pop())))
            path += [[False, []] for _ in range(len(string) - same)]
            path[-1][0] = True
            last = string
        for i in range(len(last), 0, -1):
            path[i - 1][1].append((last[i - 1], freeze(path.pop())))
        self.start = freeze(path[0])


class OneEdit:
    """The acceptor, a transducer that makes exactly one edit, and the acceptor again.

    A deletion from a run of equal symbols counts for the first of the run alone, so that every pair
    has one accepting path.
    """

    def __init__(self, acceptor: Acceptor):
        self.of = acceptor
        self.shared: dict[tuple[int, int], tuple | list] = {}
        self.edits: dict[int, tuple[list, list]] = {}

    def common(self, p: int, q: int) -> tuple | list:
        """Numbers, from ``p`` and from ``q``, of the strings that both states accept: what follows an edit."""
        shared, arcs, final = self.shared, self.of.arcs, self.of.final
        stack = [(p, q)]
        while stack:
            key = stack[-1]
            if key in shared:
                stack.pop()
                continue
            left, right = arcs[key[0]], arcs[key[1]]
            both = left.keys() & right.keys()
            need = [x for s in both if (x := (left[s][0], right[s][0])) not in shared]
            if need:
                stack += need
                continue
            found = [(0, 0)] if final[key[0]] and final[key[1]] else []
            for s in both:
                (a, i), (b, j) = left[s], right[s]
                found += [(i + x, j + y) for x, y in shared[a, b]]
            shared[key] = found or ()
            stack.pop()
        return shared[p, q]

    def at(self, q: int) -> tuple[list, list]:
        """Edits made at a state that both acceptors are in: replaced pairs (number, number), and
        (symbol, longer, shorter) for a deleted symbol."""
        found = self.edits.get(q)
        if found is None:
            replaced, deleted = [], []
            arcs = list(self.of.arcs[q].items())
            for k, (symbol, (a, i)) in enumerate(arcs):
                for _, (b, j) in arcs[:k]:
                    replaced += [(i + x, j + y) for x, y in self.common(a, b)]
                deleted += [(symbol, i + x, y) for x, y in self.common(a, q)]
            found = self.edits[q] = (replaced, deleted)
        return found

    def pairs(self, before: str = "") -> Iterator[tuple[int, int, bool]]:
        """(number, number, whether the first is the longer one) of all accepted pairs; ``before`` is
        the symbol that precedes all strings."""
        stack = [(self.of.start, 0, before)]
        while stack:
            q, base, last = stack.pop()
            replaced, deleted = self.at(q)
            for i, j in replaced:
                yield base + i, base + j, False
            for symbol, i, j in deleted:
                if symbol != last:
                    yield base + i, base + j, True
            for symbol, (target, number) in self.of.arcs[q].items():
                stack.append((target, base + number, symbol))


def _accepted(mids: list[str], before: str, short: list[bool]) -> Iterator[tuple[int, int]]:
    """Pairs of positions in the sorted ``mids`` that lie one edit apart. A short one only counts as the
    shorter of two."""
    some = any(short)
    for i, j, longer in OneEdit(Acceptor(mids)).pairs(before):
        if not some or (not short[i] and (longer or not short[j])):
            yield i, j


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (head, tail, mid, short, n) of one key after the other; rows come sorted."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word of a partition its number of near words there, and the best of them."""
    names = ["word", "n", "n_near", "best_n", "best"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for rows in _groups(batches):
        head, tail = rows[0][:2]
        near, best = [0] * len(rows), [None] * len(rows)
        words, counts = [head + r[2] + tail for r in rows], [r[4] for r in rows]
        if len(rows) > 1:
            for i, j in _accepted([r[2] for r in rows], head[-1:], [r[3] for r in rows]):
                for a, b in ((i, j), (j, i)):
                    near[a] += 1
                    c = best[a]
                    if c is None or counts[b] > counts[c] or (counts[b] == counts[c] and words[b] < words[c]):
                        best[a] = b
        for k, row in enumerate(rows):
            # Every word has one row with this mark, so that none is lost.
            if near[k] or (not head and not row[3]):
                c = best[k]
                out.append((words[k], counts[k], near[k], None if c is None else counts[c], None if c is None else words[c]))
        if len(out) >= 10_000:
            yield batch()
    yield batch()


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches):
        if len(rows) > 1:
            words = [rows[0][0] + r[2] + rows[0][1] for r in rows]
            found = list(_accepted([r[2] for r in rows], rows[0][0][-1:], [r[3] for r in rows]))
            columns = [pa.array([words[p[k]] for p in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "near"])


def _row(head: Column | str, mid: Column | str, tail: Column | str, short: bool) -> Column:
    parts = [x if isinstance(x, Column) else F.lit(x) for x in (head, tail, mid)]
    return F.struct(*[x.alias(n) for x, n in zip(parts, ("head", "tail", "mid"), strict=True)], F.lit(short).alias("short"))


def _from(word: Column, start: int) -> Column:
    return F.substring(word, start + 1, 1 << 30)


def _to(word: Column, end: int) -> Column:
    return F.substring(word, 1, end)


def partitions(words: DataFrame, *, most: int = PARTITION_WORDS) -> DataFrame:
    """(head, tail, mid, short, n): the words by initial states of the composition. No (head, tail) has
    more than ``most`` words, or what the alphabet allows in ``HEAD`` symbols."""
    word = F.col("word")
    closed = F.array_compact(
        F.array(
            _row("", _to(word, HEAD), _from(word, HEAD), False),
            F.when(F.length(word) >= HEAD, _row("", _to(word, HEAD - 1), _from(word, HEAD - 1), True)),
        )
    )
    done = [words.select(F.inline(closed), "n")]
    open_, depth = words, HEAD
    while True:
        head = _to(word, depth)
        counts = open_.groupBy(head.alias("head")).count().where(F.col("count") > most)
        crowded = materialize(counts.select(F.col("head").alias("crowded")), "crowded")
        whole = _row(head, _from(word, depth), "", False)
        if crowded.isEmpty():
            done.append(open_.select(F.inline(F.array(whole)), "n"))
            break
        # At most one row for every ``most`` words.
        on, few = head == F.col("crowded"), F.broadcast(crowded)
        done.append(open_.join(few, on, "left_anti").select(F.inline(F.array(whole)), "n"))
        split = materialize(open_.join(few, on, "left_semi"), "split")
        here = F.array_compact(
            F.array(
                F.when(F.length(word) > depth, _row(head, F.substring(word, depth + 1, 1), _from(word, depth + 1), False)),
                _row(head, "", _from(word, depth), True),
            )
        )
        done.append(split.select(F.inline(here), "n"))
        open_, depth = split.where(F.length(word) > depth), depth + 1
    return reduce(DataFrame.unionByName, done)


def _composed(words: DataFrame, run, schema: str, most: int) -> DataFrame:
    rows = partitions(words, most=most).repartition("head", "tail").sortWithinPartitions("head", "tail", "mid")
    return rows.select("head", "tail", "mid", "short", "n").mapInArrow(run, schema)


def _vocabulary(words: DataFrame) -> DataFrame:
    known = words.where("word <> ''").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    return materialize(known, "vocabulary")


def near_pairs(words: DataFrame, *, most: int = PARTITION_WORDS) -> DataFrame:
    """(word, near): every pair of different words one edit apart, once."""
    return _composed(_vocabulary(words), _pairs, "word string, near string", most)


def variants(words: DataFrame, *, ratio: float = RATIO, most: int = PARTITION_WORDS) -> DataFrame:
    """For every word (columns ``word``, ``n``): its form, its root and its near words.

    Two words are near if exactly one inserted, deleted or replaced code point makes one the other.
    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if its ``n``,
    then ``form_n``, is at least ``ratio`` times the word's; else both are null. ``root`` is where
    following forms ends, the word itself if it has none. ``n_near`` counts the near words.

    Null and empty words take no part; rows of the same word are summed, null counts as zero; other
    columns are ignored; words may be of any length; no words give no rows.
    """
    found = _composed(
        _vocabulary(words.select("word", F.coalesce("n", F.lit(0)).alias("n"))), _summaries,
        "word string, n long, n_near long, best_n long, best string", most,
    )
    # Largest n first, then the smallest word: nulls, of words without near ones, come last.
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))))
    whole = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    named = F.expr(f"n * {ratio} <= -best.n")
    whole = materialize(
        whole.select(
            "word", "n", "n_near", F.when(named, F.col("best.word")).alias("form"), F.when(named, -F.col("best.n")).alias("form_n")
        ),
        "near-words",
    )
    roots = _roots(whole.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    done = whole.join(roots, "word", "left")
    return done.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form, following twice as many forms in every round. Each form has
    a larger n than its word, so there are no rings, and rounds are few."""
    links = materialize(links, "roots")
    while True:
        further = links.select(F.col("word").alias("at"), F.col("root").alias("to"))
        step = links.join(further, F.col("root") == F.col("at"), "left")
        step = step.select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            return links


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_count: int = 5,
                slip: int | None = None) -> DataFrame:
    """(word, n): how often the lower-cased letter runs of the whole texts occur.

    Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. With ``slip``, a run loses a
    code point if ``slip`` divides h, the CRC-32 of ``<id>:<run>``: the one at h modulo its length.
    Null texts have no words; a null id counts as empty. Counts are summed before they move.
    """
    letters = f"[a-zÀ-ÿ]{{{min_length},}}"
    lower = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(letters), F.lit(0))).alias("run"),
    )
    word = F.col("run")
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        place = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slip == 0, F.overlay("run", F.lit(""), place + 1, F.lit(1))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)
