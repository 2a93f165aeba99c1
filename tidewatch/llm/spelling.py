"""Spelling variants: words one edit apart, found with forward and backward minimal acyclic automata.

An edit stands in a word's second half or in its first. In the first case the word
shares at least its first half with its neighbour, so a walk through an automaton of words matches
that half exactly and completes the rest with one error; in the second case the same is
done with both words turned round, in an automaton of turned words. The automata are minimal
(equal subtrees are one state) and number their words: each edge knows how many words come before it, so that
the number reached on a walk finds the word and its count in plain arrays.

Words are dealt to automata by a few first letters (or last ones, turned round), no more than half a word,
so those that can meet stand in one automaton. Automata of very common letters are divided:
every part takes its share of the words and all the queries. Neighbours that share the
first half are reported by the forward automata alone, so none counts twice.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tables import cut, looked_up, table

RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, TIMES, DAMAGE = 7, 2, 10, 31
LETTERS = ((7, 3), (10, 5), (16, 8))  # (words from so many code points, letters that deal them); at most half of the word
SHARD_WORDS, SLICE_WORDS = 20_000, 200_000  # entries of one automaton, queries that a task asks it
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PART = "word string, n_near long, form_n long, form string"


# words -----------------------------------------------------------------------------------


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def word_counts(docs: DataFrame, least: int = LEAST_LETTERS, most_rare: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of whole texts with at least least code points and most_rare occurrences.

    A run whose crc32 with its doc_id is divisible by 31 loses the letter that the crc32 points at.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_doc"), F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.where(F.length("_run") >= least).withColumn("_run", lower_ascii(F.col("_run")))
    h, n = F.crc32(F.concat("_doc", F.lit(":"), "_run").cast("binary")), F.length("_run")
    at = F.pmod(h, n).cast("int")
    word = F.when(F.pmod(h, F.lit(DAMAGE)) == 0, F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, n))).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= most_rare)


# automata --------------------------------------------------------------------------------


class Automaton:
    """A minimal acyclic automaton of ascending distinct words. A state is (final, {letter: (words before, state)})."""

    def __init__(self, words: list[str]):
        self.known: dict[tuple, tuple] = {}
        path, last = [(False, {})], ""  # open states, from the root along the last word
        for word in words:
            k = 0
            while k < len(last) and k < len(word) and last[k] == word[k]:
                k += 1
            self._close(path, last, k)
            path += [(i == len(word) - 1, {}) for i in range(k, len(word))]
            last = word
        self._close(path, last, 0)
        self.root = self._numbered(path[0][0], path[0][1])[1]

    def _close(self, path: list, word: str, to: int) -> None:
        """Replaces the open states below the first to letters of word by equal known ones."""
        for i in range(len(word), to, -1):
            final, edges = path.pop()
            path[-1][1][word[i - 1]] = self._numbered(final, edges)

    def _numbered(self, final: bool, edges: dict) -> tuple:
        """(words below, state) of a finished state; edges hold (words below, state)."""
        key = (final, *[(c, id(s)) for c, (_, s) in edges.items()])
        found = self.known.get(key)
        if found is None:
            out, before = {}, int(final)
            for c, (n, s) in edges.items():
                out[c] = (before, s)
                before += n
            found = self.known[key] = (before, (final, out))
        return found

    def number(self, word: str) -> int | None:
        """The word's place among the words, or None."""
        at, state = 0, self.root
        for c in word:
            if (edge := state[1].get(c)) is None:
                return None
            at, state = at + edge[0], edge[1]
        return at if state[0] else None

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that share the first exact letters of word and differ from it by one edit behind them."""
        at, state, found = 0, self.root, set()
        for c in word[:exact]:
            if (edge := state[1].get(c)) is None:
                return found
            at, state = at + edge[0], edge[1]

        def finish(n: int, s: tuple, i: int) -> None:
            for c in word[i:]:
                if (e := s[1].get(c)) is None:
                    return
                n, s = n + e[0], e[1]
            if s[0]:
                found.add(n)

        for i in range(exact, len(word) + 1):
            c = word[i] if i < len(word) else None
            if c is not None:
                finish(at, state, i + 1)  # deleted from word
            for x, (n, s) in state[1].items():
                finish(at + n, s, i)  # inserted
                if c is not None and x != c:
                    finish(at + n, s, i + 1)  # replaced
            if c is None or (edge := state[1].get(c)) is None:
                break
            at, state = at + edge[0], edge[1]
        if (own := self.number(word)) is not None:
            found.discard(own)
        return found


def near_words(group: pd.DataFrame) -> pd.DataFrame:
    """For the queries of one automaton: number of near words, and the most frequent (then smallest) of them."""
    backward = bool(group["backward"].iloc[0])
    listed = group[group["listed"]]
    counts = dict(zip(listed["key"].tolist(), listed["n"].tolist(), strict=True))
    keys = sorted(counts)
    automaton, out = Automaton(keys), []
    for query in group.loc[group["asked"], "key"].tolist():
        half = len(query) // 2
        near = [keys[k] for k in automaton.near(query, len(query) - half if backward else half)]
        if backward:  # turned round again; pairs that share the first half are the forward automaton's
            query, turned = query[::-1], [(w[::-1], counts[w]) for w in near]
            near = [(w, n) for w, n in turned if w[:half] != query[:half]]
        else:
            near = [(w, counts[w]) for w in near]
        if near:
            top = max(n for _, n in near)
            out.append((query, len(near), top, min(w for w, n in near if n == top)))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"]).astype({"n_near": "int64", "form_n": "int64"})


def _class_letters(length: Column) -> Column:
    """How many letters deal the queries of this length."""
    out = F.lit(LETTERS[0][1])
    for least, letters in LETTERS[1:]:
        out = F.when(length >= least, F.lit(letters)).otherwise(out)
    return out


def dealt(words: DataFrame, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(shard, alone, part, slice, backward, key, n, listed, asked): words as entries and as queries of their automata.

    A word is asked under its own length's number of letters and listed under those of all
    lengths that differ by at most one. Letters that more than half of shard_words entries
    share have automata of their own: entries are divided into parts of shard_words, queries
    into slices of slice_words, and each part meets each slice.
    """
    length, flag = F.length("word"), F.explode(F.array(F.lit(False), F.lit(True)))
    kinds = F.array_distinct(F.array(*[_class_letters(length + k) for k in (-1, 0, 1)]))
    rows = words.select("word", "n", _class_letters(length).alias("own"), F.explode(kinds).alias("letters")).withColumn("backward", flag)
    key = F.when(F.col("backward"), F.reverse("word")).otherwise(F.col("word"))
    head = F.xxhash64("backward", "letters", F.substring(key, F.lit(1), F.col("letters")))
    rows = rows.select(key.alias("key"), "n", "backward", (F.col("own") == F.col("letters")).alias("asked"), head.alias("head"))
    heads = cut(rows.groupBy("head").agg(F.count("*").alias("entries")))
    automata = max(1, -(-(heads.agg(F.sum("entries")).first()[0] or 0) // shard_words))
    count = lambda size: F.ceil(F.col("entries") / size).cast("int")
    large = cut(heads.where(F.col("entries") > shard_words // 2).select("head", count(shard_words).alias("parts"), count(slice_words).alias("slices")))
    rows = looked_up(rows, large, "head", F.col("key"), "left")
    spots = F.expr("""CASE WHEN parts IS NULL THEN array(struct(0 AS part, 0 AS slice, true AS listed, asked AS asked)) ELSE concat(
        transform(sequence(0, slices - 1), s -> struct(cast(pmod(xxhash64(key, 'part'), parts) AS int) AS part, s AS slice, true AS listed, false AS asked)),
        filter(transform(sequence(0, parts - 1), p -> struct(p AS part, cast(pmod(xxhash64(key, 'slice'), slices) AS int) AS slice, false AS listed, asked AS asked)), x -> x.asked)) END""")
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("head", F.lit("shard")), F.lit(automata))).otherwise(F.col("head"))
    rows = rows.select(shard.alias("shard"), F.col("parts").isNotNull().alias("alone"), "backward", "key", "n", F.explode(spots).alias("spot"))
    return rows.select("shard", "alone", "backward", "key", "n", "spot.*")


def variant_groups(docs: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS, slice_words: int = SLICE_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n and root for each word of docs (doc_id, text) with at least 7 code points and 2 occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF in whole texts, A-Z lower-cased.
    Two words are near if one inserted, deleted or replaced code point makes them equal.
    The form is the most frequent near word (of equally frequent ones the smallest) if it
    is at least times as frequent as the word; the root is where forms end. Null texts have no
    words, a null doc_id counts as an empty one, repeated rows count each time; other columns
    aren't read. An empty table gives no rows.
    """
    words = cut(word_counts(docs))
    found = dealt(words, shard_words, slice_words).groupBy("shard", "alone", "backward", "part", "slice").applyInPandas(near_words, _PART)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    whole = words.join(near, "word", "left")
    takes = F.coalesce(-F.col("best.less") >= times * F.col("n"), F.lit(False))
    forms = cut(whole.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n")))
    roots = followed(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def followed(links: DataFrame) -> DataFrame:
    """(word, root): links from words to their forms followed to the last. Each round doubles the steps; counts grow
    tenfold along a step, so a few rounds do."""
    links = cut(links)
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(looked_up(links, ahead, "root", F.col("word"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        links = moved.select("word", "root")
        if not moved.where("_moved").limit(1).count():
            return links


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variant_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
told AS (SELECT d, run, count(*) AS n, list_transform(string_split(d || ':' || run, ''), lambda x: CAST(unicode(x) AS BIGINT)) AS points FROM runs WHERE length(run) >= 7 GROUP BY d, run),
coded AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(points, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM told, crc_table),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, n FROM coded),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, k, word[1 : k - 1] || word[k + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON w.word = c.rest),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
firsts AS (SELECT b.word, b.n_near, b.top, min(p.other) AS form FROM best b JOIN pairs p ON p.word = b.word AND p.n = b.top GROUP BY ALL),
forms AS (SELECT w.word, w.n, coalesce(f.n_near, 0) AS n_near, CASE WHEN f.top >= 10 * w.n THEN f.form END AS form, CASE WHEN f.top >= 10 * w.n THEN f.top END AS form_n FROM words w LEFT JOIN firsts f ON f.word = w.word),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.n, f.n_near, f.form, CAST(f.form_n AS DOUBLE) AS form_n, w.at AS root FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL
"""
