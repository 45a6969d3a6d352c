"""Chat formatting: perspective rotation of conversations with several speakers.

For every speaker of a conversation (every role but `system`) the dialogue is rendered once: the speaker's own turns as the
assistant's, the others' as named users', system turns as such, with the characters of the speaker's own turns as masks. A
dialogue is rendered in parts of PART turns by number, so that no conversation has to fit in one task; the speakers of a
conversation are a set with partial aggregation, joined back to the turns.

Marks can't be forged: `<|` in a text becomes `<||`, and `%`, `|`, `<`, `>` and line breaks in a name their percent codes.

Defined cases: a null role is the speaker "unknown"; a null text is empty; a null conv_id has no conversation and is left out; turns
with equal or null numbers stand in the order of what they render to, a null number first; repeated rows are rendered as often as
they stand; a conversation of system turns only has no rows; white space around a role goes; a very long text is one segment; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize

SYSTEM, PART = "system", 256
#: Characters of a name that could end its mark.
CODES = [("%", "%25"), ("|", "%7C"), ("<", "%3C"), (">", "%3E"), ("\n", "%0A"), ("\r", "%0D")]


def escaped(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def encoded(name: Column) -> Column:
    for char, code in CODES:
        name = F.replace(name, F.lit(char), F.lit(code))
    return name


def perspectives(conversations: DataFrame) -> DataFrame:
    """(conv_id, speaker, turn, shown_role, name, segment, train) of every turn and speaker."""
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", F.coalesce(F.trim("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    speakers = materialize(turns.filter(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("speaker")).distinct(), "speakers")
    each = turns.join(speakers, "conv_id")
    mine = F.col("role") == F.col("speaker")
    shown = F.when(mine, "assistant").when(F.col("role") == SYSTEM, SYSTEM).otherwise("user")
    name = F.when(shown == "user", F.col("role"))
    head = F.concat(F.lit("<|"), shown, F.when(name.isNotNull(), F.concat(F.lit(" name="), encoded(name))).otherwise(F.lit("")), F.lit("|>\n"))
    return each.select("conv_id", "speaker", "turn", shown.alias("shown_role"), name.alias("name"), F.concat(head, escaped(F.col("text")), F.lit("<|end|>\n")).alias("segment"), mine.alias("train"))


def masked(rendered: DataFrame) -> DataFrame:
    """mask_start and mask_end: the characters of the segment, the end mark included, that a loss may use; 0 and 0 where none."""
    head = F.locate("|>\n", F.col("segment")) + 2
    return rendered.withColumns({"mask_start": F.when(F.col("train"), head.cast("long")).otherwise(0), "mask_end": F.when(F.col("train"), (F.length("segment") - 1).cast("long")).otherwise(0)})


def dialogues(conversations: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, speaker, part, n_turns, dialogue, masks): masks are (start, end) of characters of the part's dialogue."""
    turns = masked(perspectives(conversations)).withColumn("part", F.floor(F.coalesce("turn", F.lit(0)) / part))
    one = turns.groupBy("conv_id", "speaker", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "segment", "train", "mask_start", "mask_end"))).alias("s"))
    place = "struct(a.at + length(x.segment) as at, if(x.train, array_append(a.masks, struct(a.at + x.mask_start as start, a.at + x.mask_end as end)), a.masks) as masks)"
    masks = F.expr(f"aggregate(s, struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as masks), (a, x) -> {place}).masks")
    return one.select("conv_id", "speaker", "part", F.size("s").cast("long").alias("n_turns"), F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("dialogue"), masks.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dialogues(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return d.withColumn("masks", F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ","))


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(trim(role, ' '), 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (SELECT conv_id, speaker, turn, CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user' END AS shown_role,
             CASE WHEN role <> speaker AND role <> 'system' THEN role END AS name, text, role = speaker AS train FROM t JOIN s USING (conv_id)),
g AS (SELECT *, '<|' || shown_role || coalesce(' name=' || replace(replace(replace(replace(replace(replace(name, '%', '%25'), '|', '%7C'), '<', '%3C'), '>', '%3E'), chr(10), '%0A'), chr(13), '%0D'), '') || '|>' || chr(10) AS head FROM r),
h AS (SELECT conv_id, speaker, turn, coalesce(turn, 0) // 256 AS part, train, length(head) AS n, head || replace(text, '<|', '<||') || '<|end|>' || chr(10) AS segment FROM g),
o AS (SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM h)
SELECT conv_id, speaker, part::BIGINT AS part, count(*)::BIGINT AS n_turns, string_agg(segment, '' ORDER BY turn NULLS FIRST, segment, off) AS dialogue,
       coalesce(string_agg((off + n)::VARCHAR || '-' || (off + length(segment) - 1)::VARCHAR, ',' ORDER BY off) FILTER (train), '') AS masks FROM o GROUP BY 1, 2, 3
"""
