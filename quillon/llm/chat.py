"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes one example: the turns before it are the context, the turn itself is
the target, and only the target's text is trainable. Turns after a conversation's last assistant
turn (or all, if it has none) end in one more example without a target, so no turn is lost.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. A control string inside a text
or role gets one more ``~`` after its first character (``<|im_end|>`` becomes ``<~|im_end|>``,
which itself would become ``<~~|im_end|>``); taking one ``~`` away restores it. So no formatted text
holds a control string that the template did not write, and each text reads back unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import documents

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings without their first character, of this template and of bracketed instruction templates.
_TAILS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + _TAILS, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + _TAILS, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role is one line: its line ends are written as ~1 and its tildes as ~0."""
    return escape(F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def format_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_chars) with one row per assistant turn and one for a rest.

    ``loss_start`` and ``loss_chars`` are the code points of ``formatted`` under the loss mask
    (null and 0 in a rest). Rows of one conversation are ordered by turn, then role, then text,
    nulls first; repeated rows are turns of their own; null roles and texts count as empty; a null
    conv_id is one conversation. Other columns are ignored; no rows give no rows.
    """
    empty = F.lit("")
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda t: F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", head).alias("heads"),
        F.transform("turns", lambda t: escape(t["text"])).alias("bodies"),
    )
    n = F.size("roles")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.element_at("roles", i) == "assistant") | (i == n))
    one = parts.withColumn("ends", ends).select("*", F.posexplode("ends").alias("example", "end"))
    before = F.array_join(F.zip_with(F.slice("heads", 1, F.col("end") - 1), F.slice("bodies", 1, F.col("end") - 1), lambda h, b: F.concat(h, b, F.lit(END))), "")
    last = one.select("conv_id", "example", before.alias("before"), F.element_at("heads", F.col("end")).alias("head"), F.element_at("bodies", F.col("end")).alias("body"), (F.element_at("roles", F.col("end")) == "assistant").alias("target"))
    return last.select(
        "conv_id",
        "example",
        F.concat("before", "head", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), F.length("before") + F.length("head")).alias("loss_start"),
        F.when(F.col("target"), F.length("body")).otherwise(0).alias("loss_chars"),
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        body = F.substring(t, len(START) + 1, 2**31 - 1)
        at = F.instr(body, "\n")
        return F.struct(_unescape_role(body.substr(F.lit(1), at - 1)).alias("role"), unescape(body.substr(at + 1, F.length(body))).alias("text"))

    return F.transform(whole, turn)


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests per conversation, read back from its examples: turns from the longest, targets from the loss masks."""
    planted = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    examples = format_prefixes(documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
    target = unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_chars")))
    read = examples.select("conv_id", "example", "formatted", F.when(F.col("loss_start").isNotNull(), target).alias("target"))
    per = read.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", F.coalesce("target", F.lit("")).alias("target")))).alias("targets"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    turns = parse_turns(F.col("whole"))
    loss = F.array_join(F.transform("targets", lambda t: t["target"]), "")
    per = per.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted_chars", "n_examples")
    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"),
    )


_Q = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)"
_ESC = "regexp_replace({0}, '([<\\[])(~*)" + _Q + "', '\\1~\\2\\3', 'g')"
OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    length('{START}') + length({_ESC.format("replace(replace(role, '~', '~0'), chr(10), '~1')")}) + 1 + length({_ESC.format("text")}) + {len(END)} AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS prefix FROM f)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR k = n) AS n_examples
FROM p GROUP BY conv_id
"""
