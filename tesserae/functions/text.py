"""Column functions over text: token estimates, word sets, predicates, mentions, chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space; the first class lets most characters go at once.
_SPACE = "[[\\x09-\\x20\\u00a0-\\uffff]&&[\\s\\x0B\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's and the byte-order mark included."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null and empty."""
    return F.coalesce(F.ceil(F.length(text) / 4), F.lit(0)).cast("long")


def count_tokens(text: Column, encode: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Tokens by an encoder of batches of texts, given as a function to their numbers of tokens; the estimate without one. Null counts 0."""
    if encode is None:
        return estimate_tokens(text)
    import pandas as pd

    @F.pandas_udf("long")
    def counted(column: pd.Series) -> pd.Series:
        return pd.Series(encode(column.fillna("").tolist()), dtype="int64")

    return counted(text)


def truncate_tokens(text: Column, budget: int) -> Column:
    """The longest prefix whose estimate is within the budget; a budget of 0 or less leaves nothing."""
    return F.substring(text, 1, max(0, 4 * budget))


def fits_in_budget(text: Column, budget: int, exact: Column | None = None) -> Column:
    """A cheap estimate first: well below the budget fits, well above doesn't; between, the exact count decides."""
    estimate = estimate_tokens(text)
    return F.when(estimate < 0.8 * budget, True).when(estimate > 1.3 * budget, False).otherwise((estimate if exact is None else exact) <= budget)


def word_count(text: Column) -> Column:
    """Pieces between runs of white space; white space alone counts as one."""
    return F.size(F.split(strip(text), f"{_SPACE}+"))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[.!?;](?:{_SPACE}|\\z)"))


def quality(text: Column) -> Column:
    """rejected under 10 words, brief under 25, ok from there."""
    n = word_count(text)
    return F.when(n < 10, "rejected").when(n < 25, "brief").otherwise("ok")


def fold_ascii(text: Column) -> Column:
    """Lower case for A-Z only, as for case-insensitive keys."""
    return F.translate(text, _UPPER, _LOWER)


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"{_SPACE}+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word sets; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


# Patterns and predicates, in order; the first that is found decides.
PREDICATES = [
    (r"lives?\s+in|located\s+in|resides?\s+in|based\s+in", "located_in"),
    (r"works?\s+(?:at|for)|employed\s+(?:at|by)", "works_at"),
    (r"likes?|loves?|enjoys?|prefers?", "prefers"),
    (r"hates?|dislikes?|avoids?", "dislikes"),
    (r"is\s+a|is\s+an|is\s+the", "is_a"),
    (r"has|owns?|possesses?", "has"),
    (r"knows?|met|friends?\s+with", "knows"),
    (r"wants?\s+to|plans?\s+to|intends?\s+to|going\s+to", "wants_to"),
    (r"created?|built|made|wrote|authored", "created"),
    (r"uses?|utilizes?", "uses"),
    (r"visited|went\s+to|traveled\s+to", "visited"),
    (r"learned|studied|knows\s+about", "learned"),
    (r"born\s+in|from", "from"),
    (r"married\s+to|spouse|partner", "married_to"),
    (r"parent\s+of|father\s+of|mother\s+of", "parent_of"),
    (r"child\s+of|son\s+of|daughter\s+of", "child_of"),
    (r"member\s+of|part\s+of|belongs?\s+to", "member_of"),
    (r"manages?|leads?|heads?", "manages"),
    (r"reports?\s+to|supervised\s+by", "reports_to"),
    (r"teaches?|mentors?|coaches?", "teaches"),
]
# Words that alone are no mention.
STOP_WORDS = """The This That What When Where Who Why How I You We They He She It My Your Our Can Could Would Should Do Does Did Is Are
Was Were Has Have Had Will And But Or Not No Yes If Then So Also Just Only About After Before Between From Into For With""".split()


def infer_predicate(text: Column) -> Column:
    """Word boundaries are ASCII's, so they are spelt out."""
    low = F.lower(text)
    found = lambda p: F.rlike(low, F.lit(f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"))
    first, *rest = PREDICATES
    return reduce(lambda c, p: c.when(found(p[0]), p[1]), rest, F.when(found(first[0]), first[1])).otherwise("related_to")


def entity_mentions(text: Column) -> Column:
    """Capitalised phrases, then quoted strings; distinct, without lone stop words and single characters."""
    phrases = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*"), F.lit(0))
    quoted = F.transform(F.regexp_extract_all(text, F.lit('"[^"]+"'), F.lit(0)), lambda q: F.translate(q, '"', ""))
    return F.filter(F.array_except(F.array_union(phrases, quoted), F.array(*map(F.lit, STOP_WORDS))), lambda e: F.length(e) > 1)


def sentence_chunks(text: Column, budget: int) -> Column:
    """Sentences packed greedily into chunks within the budget; a longer sentence is a chunk of its own.

    A text within the budget is one chunk as it is; empty texts have none; the last chunk is dropped if blank.
    """
    sentences = F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?\n]*"), F.lit(0))
    sentences = F.when(F.size(sentences) == 0, F.array(text)).otherwise(sentences)
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        n = estimate_tokens(s)
        full = (acc["n"] + n > budget) & (F.length(acc["open"]) > 0)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(F.concat(acc["open"], s)).alias("open"), F.when(full, n).otherwise(acc["n"] + n).alias("n"))

    packed = F.aggregate(sentences, zero, step, lambda acc: F.when(F.length(strip(acc["open"])) > 0, F.concat(acc["done"], F.array(strip(acc["open"])))).otherwise(acc["done"]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(estimate_tokens(text) <= budget, F.array(text)).otherwise(packed)


def to_fixed(number: Column, digits: int) -> Column:
    """Decimal text of the exact binary value, ties away from zero. Only odd multiples of 2**-(digits+1) are exact ties."""
    x = number.cast("double")
    scaled = F.abs(x) * float(2 ** (digits + 1))
    tie = (scaled == F.floor(scaled)) & (scaled % 2 == 1)
    return F.translate(F.format_number(F.when(tie, x + F.signum(x) * 1e-9).otherwise(x), digits), ",", "")


# Prompt templates: what a language model is asked for; the calls themselves are not made here.
# Their wording.
PROMPTS = {
    "extract_facts": """Extract all factual statements from the following text as structured triples. Output a JSON array where each element has: "subject", "predicate", "object", "subject_type", "object_type", "confidence" (0.0-1.0).

Use clear, normalized predicates like: located_in, works_at, is_a, has, prefers, knows, wants_to, created, uses, born_in, member_of, etc.

Text:
{text}

Output only the JSON array, no other text.""",
    "compress_session": """Compress the following conversation working memory into a concise summary of ~200 tokens. Preserve:
1. Key decisions made
2. Important facts learned about the user
3. Unresolved questions or pending items
4. Action items or next steps
5. Emotional context if notable

Aggressively compress redundant dialogue, greetings, and filler. Keep only high-information-density content.

Working Memory:
{text}

Output only the compressed summary.""",
    "consolidate_epoch": """Merge the following session summaries into a single epoch summary of ~100 tokens. Focus on:
1. Recurring themes and patterns
2. Evolving user preferences
3. Long-term goals and progress
4. Significant milestones or decisions

Session Summaries:
{text}

Output only the consolidated epoch summary.""",
}


def prompt(name: str, text: Column) -> Column:
    if name not in PROMPTS:
        raise ValueError(f"Unknown prompt: {name}")
    before, after = PROMPTS[name].split("{text}")
    return F.concat(F.lit(before), F.coalesce(text, F.lit("")), F.lit(after))
