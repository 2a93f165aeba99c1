"""Preference formatting of chosen and rejected conversations with DataFrame functions.

A pair of conversations shares its longest common prefix of turns. That prefix is rendered
once, as the prompt; the turns after it become two completions, each with the character
spans that a loss may train on: the words of assistant turns with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.tables import cut, table

TRAINED = "assistant"
END = "<|end|>"
RING = 500


def conversations(turns: DataFrame, by: str = "conv_id") -> DataFrame:
    """One row per conversation: by, turns array<struct<role, text>> in the order of turn, role, text.

    Repeated rows count once; null roles and texts are empty; a null turn comes first. Rows
    with a null key are one conversation of that key.
    """
    one = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(by, one.alias("t")).groupBy(by).agg(F.sort_array(F.collect_set("t")).alias("t"))
    return rows.select(by, F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END + "\n"))


def _spans(turns: Column) -> Column:
    """The trained spans of rendered turns, as array<struct<start, end>> of characters."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        begin = acc["at"] + F.length(turn["role"]) + F.lit(5)
        end = begin + F.length(turn["text"]) + F.lit(len(END))
        own = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + F.lit(1)).cast("long").alias("at"), F.when(turn["role"] == TRAINED, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Replaces the turn arrays of pairs by prompt, both completions and their trained spans.

    n_prompt_turns is the length of the longest common prefix of turns (equal role and text).
    Where one conversation continues the other, the shorter's completion is empty; equal
    conversations have two empty completions. A null conversation counts as one without
    turns. Other columns pass through; those with the names of results are replaced.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    rows = pairs.withColumns({"_c": F.coalesce(chosen, empty), "_r": F.coalesce(rejected, empty)})
    shared = F.least(F.size("_c"), F.size("_r"))
    unlike = F.filter(F.sequence(F.lit(1), shared), lambda i: (i <= shared) & ~F.element_at("_c", i).eqNullSafe(F.element_at("_r", i)))
    rows = rows.withColumn("n_prompt_turns", F.when(shared == 0, F.lit(0)).otherwise(F.coalesce(F.get(unlike, F.lit(0)) - 1, shared)))
    rest = {side: F.slice(col, F.col("n_prompt_turns") + 1, F.size(col)) for side, col in (("_c", F.col("_c")), ("_r", F.col("_r")))}
    rows = rows.withColumns({"_cr": rest["_c"], "_rr": rest["_r"]})
    done = {
        "prompt": F.array_join(F.transform(F.slice("_c", F.lit(1), F.col("n_prompt_turns")), _render), ""),
        "chosen": F.array_join(F.transform("_cr", _render), ""), "chosen_spans": _spans(F.col("_cr")),
        "rejected": F.array_join(F.transform("_rr", _render), ""), "rejected_spans": _spans(F.col("_rr")),
    }
    return rows.withColumns(done).drop("_c", "_r", "_cr", "_rr")


def replies_borrowed(turns: DataFrame) -> DataFrame:
    """Preference pairs of all plain conversations: each is chosen; rejected is the same with its last
    assistant reply replaced by that of the neighbour conv_id xor 1 or, where that is missing or
    has none, of the next conversation with a reply (of the last: the one before) in the order
    of a digest within buckets of about RING conversations.

    Without a reply of one's own or any donor, rejected ends before the last reply: its
    completion is empty.
    """
    reply = donors(turns)
    alone = F.broadcast(reply.where("conv_id IS NULL").agg(F.max("reply").alias("_null")))  # a null key meets nothing in a join
    held = conversations(turns).withColumn("last", F.array_max(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == TRAINED)))
    held = held.join(reply, "conv_id", "left").crossJoin(alone).withColumn("reply", F.when(F.col("conv_id").isNull(), F.col("_null")).otherwise(F.col("reply")))
    swapped = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i + 1 == F.col("last"), F.col("reply")).otherwise(t["text"]).alias("text")))
    ended = F.when(F.col("last").isNull(), F.col("turns")).when(F.col("reply").isNull(), F.slice("turns", F.lit(1), F.col("last") - 1)).otherwise(swapped)
    return held.select("conv_id", F.col("turns").alias("chosen"), ended.alias("rejected"))


def donors(turns: DataFrame) -> DataFrame:
    """(conv_id, reply): what each conversation's last reply is replaced by. Only last replies travel, one a conversation."""
    last = F.max(F.when(F.col("role") == TRAINED, F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    own = cut(turns.groupBy("conv_id").agg(last.alias("m")).select("conv_id", F.col("m.text").alias("own"), F.md5(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")).alias("h")))
    buckets = max(1, own.count() // RING)
    ring = W.partitionBy(F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets)), F.col("own").isNotNull()).orderBy("h", "conv_id")
    near = own.where("conv_id IS NOT NULL AND own IS NOT NULL").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("own").alias("near"))
    far = own.withColumn("far", F.coalesce(F.lead("own").over(ring), F.lag("own").over(ring)))
    return far.join(near, "conv_id", "left").select("conv_id", F.coalesce("near", "far").alias("reply"))


def op1_preference_format(spark, sf_dir: str) -> DataFrame:
    """One row for every conversation."""
    done = format_pairs(replies_borrowed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return done.select("conv_id", "n_prompt_turns", "prompt", "chosen", written("chosen_spans").alias("chosen_mask"), "rejected", written("rejected_spans").alias("rejected_mask"))


OP1_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
last AS (SELECT conv_id, max(i) FILTER (WHERE role = 'assistant') AS i, md5(coalesce(CAST(conv_id AS VARCHAR), '')) AS h FROM o GROUP BY conv_id),
own AS (SELECT l.*, o.text AS own, CAST('0x' || l.h[1:8] AS BIGINT) % greatest(1, (SELECT count(*) FROM last) // {RING}) AS bucket FROM last l LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM l.conv_id AND o.i = l.i),
far AS (SELECT *, coalesce(lead(own) OVER w, lag(own) OVER w) AS far FROM own WINDOW w AS (PARTITION BY bucket, i IS NOT NULL ORDER BY h, conv_id)),
swap AS (SELECT f.conv_id, f.i, coalesce(n.own, f.far) AS reply FROM far f LEFT JOIN own n ON n.conv_id = xor(f.conv_id, 1) AND n.i IS NOT NULL),
both_ AS (SELECT o.conv_id, o.i, o.role, o.text AS c, CASE WHEN s.i IS NULL OR o.i < s.i THEN o.text WHEN reply IS NULL THEN NULL WHEN o.i = s.i THEN reply ELSE o.text END AS r FROM o JOIN swap s ON s.conv_id IS NOT DISTINCT FROM o.conv_id),
pre AS (SELECT conv_id, coalesce(min(i) FILTER (WHERE r IS NULL OR c <> r) - 1, count(*)) AS n FROM both_ GROUP BY conv_id),
pieces AS (SELECT b.conv_id, b.i, b.role, p.n, length(b.role) + 5 AS head, length(c) + 7 AS nc, length(r) + 7 AS nr,
                  '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS pc, '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS pr
           FROM both_ b JOIN pre p ON p.conv_id IS NOT DISTINCT FROM b.conv_id),
placed AS (SELECT *, coalesce(sum(head + nc + 1) FILTER (WHERE i > n) OVER w, 0) AS ac, coalesce(sum(head + nr + 1) FILTER (WHERE i > n) OVER w, 0) AS ar
       FROM pieces WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(max(n) AS INTEGER) AS n_prompt_turns,
       coalesce(string_agg(pc, '' ORDER BY i) FILTER (WHERE i <= n), '') AS prompt,
       coalesce(string_agg(pc, '' ORDER BY i) FILTER (WHERE i > n), '') AS chosen,
       coalesce(string_agg((ac + head) || '-' || (ac + head + nc), ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(pr, '' ORDER BY i) FILTER (WHERE i > n AND pr IS NOT NULL), '') AS rejected,
       coalesce(string_agg((ar + head) || '-' || (ar + head + nr), ',' ORDER BY i) FILTER (WHERE i > n AND role = 'assistant' AND nr IS NOT NULL), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
