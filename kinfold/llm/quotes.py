"""Quotation linking for conversations, with DataFrame functions only.

A line's quote level is the number of leading ``>`` marks. Runs of lines of one level are passages; level 0 is the
message's own text. Quoted passages, their paragraphs and their lines are normalised (lower case, blanks collapsed) and
hashed, and joined to the first message of the same conversation whose own text, own passage, paragraph or line has that
hash and an earlier turn. A quote is linked if it is found as a whole, or if each of its paragraphs is, whole or line by
line; it comes from where its longest found piece does (of several, the latest). In a message without such a quote, those
of which some piece is found count as linked. The parent of a message is the message that its shallowest linked quote
comes from (of several, the latest; of quotes found in part, the one with the longest piece). Following parents up gives
the thread's first message and the depth; (conv_id, thread_turn, turn) is the reply order: a message always stands after
its parent.

Originals are pre-aggregated to one row (the first turn) for each conversation and hash, so a common line or a hot
conversation is no group of rows to be joined to each other.

Defined results: a null text is empty; a message without a linked quote starts a thread of its own (parent null, depth
0); a null conv_id or turn never links; repeated rows stay and have equal results; quotes of empty text are ignored; an
empty table gives an empty result; a very long text costs in proportion to its lines; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: transform(array(x), name -> ...)[0] names a value that is used more than once. A run of lines starts where the level
#: changes, and its lines are cut out in one piece, so the work follows the length of the text.
_PASSAGES = r"""
transform(array(transform(split(coalesce(text, ''), '\r?\n'), x -> named_struct(
    'level', length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)*)', 1), '[^>]', '')),
    'body', regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', '')))),
  l -> transform(array(filter(sequence(0, size(l) - 1), i -> i = 0 or get(l, i).level <> get(l, i - 1).level)),
    s -> transform(s, (i, k) -> named_struct('level', get(l, i).level,
      'body', array_join(transform(slice(l, i + 1, coalesce(get(s, k + 1), size(l)) - i), x -> x.body), '\n'))))[0])[0]
"""


def normal(column: str) -> str:
    return rf"trim(regexp_replace(lower({column}), '\\s+', ' '))"


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Each message with its passages (level, body), its own text and its deepest quote level."""
    own = "array_join(transform(filter(passages, p -> p.level = 0), p -> p.body), '\\n')"
    return (
        messages.select("conv_id", "turn", "role", F.expr(_PASSAGES).alias("passages"))
        .withColumn("own_text", F.expr(rf"regexp_replace({own}, '^\\s+|\\s+$', '')"))
        .withColumn("quote_level", F.expr("array_max(transform(passages, p -> p.level))"))
    )


def link_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own_text, quote_level, n_quotes, n_linked, parent_turn, thread_turn, depth of every message."""
    parsed = parse_quotes(messages)
    keyed = parsed.filter("conv_id is not null and turn is not null")
    pieces = rf"""array_distinct(filter(transform(flatten(array(
        array(own_text), transform(filter(passages, p -> p.level = 0), p -> p.body),
        split(own_text, '\\n\\s*\\n'), split(own_text, '\\n'))), x -> {normal("x")}), x -> x <> ''))"""
    originals = keyed.select("conv_id", "turn", F.explode(F.expr(pieces)).alias("piece")).groupBy("conv_id", F.md5("piece").alias("key")).agg(F.min("turn").alias("from_turn"))
    quotes = f"filter(transform(filter(passages, p -> p.level > 0), p -> named_struct('level', p.level, 'body', p.body, 'piece', {normal('p.body')})), q -> q.piece <> '')"
    runs = keyed.filter("quote_level > 0").select("conv_id", "turn", F.explode(F.expr(quotes)).alias("q")).select(
        "conv_id", "turn", "q.level", "q.body", F.md5("q.piece").alias("quote"), F.md5("q.body").alias("run"), F.expr(r"split(q.body, '\\n\\s*\\n')").alias("paragraphs")
    )
    # kind 0: the whole quote, 1: a paragraph, 2: a line of one.
    pieces = rf"""filter(flatten(array(
        array(named_struct('kind', 0, 'paragraph', cast(null as string), 'piece', {normal("body")})),
        transform(paragraphs, x -> named_struct('kind', 1, 'paragraph', md5(x), 'piece', {normal("x")})),
        flatten(transform(paragraphs, x -> transform(split(x, '\\n'), y -> named_struct('kind', 2, 'paragraph', md5(x), 'piece', {normal("y")})))))), q -> q.piece <> '')"""
    quoted = runs.select("conv_id", "turn", "level", "quote", "run", F.explode(F.expr(pieces)).alias("p")).select(
        "conv_id", "turn", "level", "quote", "run", "p.kind", "p.paragraph", F.length("p.piece").alias("size"), F.md5("p.piece").alias("key")
    ).distinct()
    linked = quoted.join(originals, ["conv_id", "key"], "left").withColumn("from_turn", F.expr("if(from_turn < turn, from_turn, null)"))
    each = ["conv_id", "turn", "level", "quote"]
    found = linked.groupBy(*each, "run", "paragraph").agg(
        F.expr("bool_or(kind < 2 and from_turn is not null) or coalesce(bool_and(if(kind = 2, from_turn is not null, null)), false)").alias("found"),
        F.max(F.expr("if(from_turn is null, null, struct(size, from_turn))")).alias("best"),
    )
    found = found.groupBy(*each, "run").agg(F.expr("bool_or(paragraph is null and found) or bool_and(paragraph is null or found)").alias("found"), F.max("best").alias("best"))
    found = found.groupBy(*each).agg(F.expr("max(struct(found, best))").alias("f")).select(*each, "f.found", "f.best")
    parents = found.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"),
        F.expr("if(count_if(found) > 0, count_if(found), count(best))").alias("n_linked"),
        F.expr("coalesce(min(if(found, struct(level, -best.from_turn as back), null)).back, min(if(best is null, null, struct(level, -best.size as less, -best.from_turn as back))).back)").alias("back"),
    )
    parents = materialise(parents.select("conv_id", "turn", "n_quotes", "n_linked", (-F.col("back")).alias("parent_turn")), "parents")
    # Pointer jumping: each round doubles the way up; it ends when no message's top has a parent.
    tops = parents.filter("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("top"), F.lit(1).cast("long").alias("depth"))
    tops = materialise(tops, "tops")
    while True:
        up = tops.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"))
        if tops.join(up, ["conv_id", "top"], "left_semi").isEmpty():
            break
        jumped = tops.join(up, ["conv_id", "top"], "left").select(
            "conv_id", "turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
        )
        before, tops = tops, materialise(jumped, "tops")
        discard(before)
    found = parents.join(tops, ["conv_id", "turn"], "left")
    zero = F.lit(0).cast("long")
    return (
        parsed.join(found, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "own_text", "quote_level",
            F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("n_linked", zero).alias("n_linked"), "parent_turn",
            F.coalesce("top", "turn").alias("thread_turn"), F.coalesce("depth", zero).alias("depth"),
        )
    )
