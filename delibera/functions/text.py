"""Column functions over text, roles, decisions, ratings and references. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that is found in ``text`` (case is ignored); ``default`` where none is."""
    out = None
    for pattern, label in rules:
        hit = F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


#: Order matters, the first match wins.
KIND_RULES = [("meta.?review", "meta_review"), ("official_?review", "official_review"), ("decision", "decision"), ("withdraw", "withdrawal"), ("rebuttal", "rebuttal"), ("public_comment", "public_comment"), ("official_comment", "official_comment"), ("comment", "comment")]
SIGNATURE_RULES = [("program_chair", "program_chair"), ("area_chair", "area_chair"), ("reviewer", "reviewer"), ("author", "author"), ("~", "public")]
TRIGGER_RULES = [("experiment|result|ablation|run", "new_evidence"), ("clarif|explain", "clarification"), ("revis|version|manuscript", "revision"), ("response|rebuttal|reply", "response")]
MOVE_RULES = [("with(out)?\\b.*\\b(cannot|unknown|unstable)", "missing_support"), ("\\b(hide|keep|leave|break|fail)s?\\b", "obstacle"), ("\\b(need|should|must)", "norm"), ("\\b(point|sign|show|decide)s?\\b", "indication"), ("\\bis\\b|\\bare\\b", "appraisal")]
TOPIC_RULES = [("metric|score|measure", "measurement"), ("token|vocabulary|byte", "tokenization"), ("notation|symbol|index", "notation"), ("hyperparam|grid search|tuning|learning.rate", "tuning"), ("domain|out-of-dist|shift|extrapol", "generalization"), ("plot|figure|caption|label|table layout", "figures"), ("ablat|module|component|removal", "ablation"), ("dataset|corpus|data source|collection", "data"), ("proof|theor|assumption|lemma|inequal", "theory"), ("baseline|rival|prior system", "baselines"), ("related|literature|citation|bibliog", "literature"), ("cost|runtime|flops|latency|memory|footprint", "resources")]


def kind_of(invitations: Column) -> Column:
    return first_match(invitations, KIND_RULES, "unknown")


def role_of(signature: Column, kind: Column) -> Column:
    """Role by signature; a decision or meta review without one falls back on its kind."""
    by_kind = F.when(kind == "decision", "program_chair").when(kind == "meta_review", "area_chair").otherwise("unknown")
    signed = first_match(signature, SIGNATURE_RULES, "")
    return F.when(signed != "", signed).otherwise(by_kind)


def valence_group(valence: Column) -> Column:
    return F.when(valence == "negative", "neg").when(valence == "positive", "pos").otherwise("hedged")


def sign_of(valence: Column) -> Column:
    return F.when(valence == "negative", -1).when(valence == "positive", 1).otherwise(0)


def accepted(decision: Column, mode: str = "broad") -> Column:
    """Three readings of an accepting decision: ``word`` (the word only), ``broad`` (any accepting form), ``like``."""
    d = F.coalesce(F.lower(decision), F.lit(""))
    if mode == "broad":
        return d.rlike("accept|oral|poster|spotlight")
    return d.contains("accept") if mode == "word" else d.like("%accept%")


def section(text: Column, name: str) -> Column:
    """The line under the ``[name]`` head of a rendered record; null where there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), rf"\[{name}\]\n([^\n]*)", 1), F.lit(""))


def leading_int(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+)", 1), F.lit("")).cast("int")


def first_decimal(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).cast("double")


def prefix_number(text: Column) -> Column:
    """``8`` or ``8: text`` as a number; anything else is null."""
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+(?:\.\d+)?)\s*(?::.*)?$", 1), F.lit("")).cast("double")


def space_count(text: Column) -> Column:
    """Spaces plus one; 0 for null."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1, F.lit(0))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct lower-case words of three letters or more, without ``stop``."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z][a-z\-]{2,}"), F.lit(0)))
    return F.array_except(found, F.array(*[F.lit(s) for s in stop])) if stop else found


def shingles(text: Column, n: int) -> Column:
    """All runs of ``n`` words; an empty array for shorter texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def padded(number: Column, digits: int) -> Column:
    """A whole number with zeros in front up to ``digits``; longer ones keep all their digits, null stays null."""
    return F.when(number.isNotNull(), F.format_string(f"%0{digits}d", number))


def numbered_lines(text: Column, prefix: str) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat(F.lit(f"[{prefix}:L"), padded(i + 1, 3), F.lit("] "), line)), "\n")


#: Where a line ends, as in Python's splitlines.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(text: Column) -> Column:
    """The lines of a text without their ends; a break at the end of the text begins no line. An empty text is one line."""
    found = F.split(text, BREAKS)
    return F.when((F.size(found) > 1) & (F.element_at(found, -1) == ""), F.slice(found, 1, F.size(found) - 1)).otherwise(found)


def identified_lines(text: Column, prefix: Column) -> Column:
    """Each line after ``[prefix:L001]``; numbers above 999 keep all their digits."""
    return F.array_join(F.transform(lines(text), lambda line, i: F.concat(F.lit("["), prefix, F.lit(":L"), padded(i + 1, 3), F.lit("] "), line)), "\n")


def line_references(text: Column) -> Column:
    """Every line that references like ``M-x:L010-L012`` name, ranges written out (both ends and all between)."""
    refs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z]-[a-z]+:L\d+(?:-L\d+)?"), F.lit(0))

    def spell(ref):
        source = F.substring_index(ref, ":", 1)
        low = F.regexp_extract(ref, r":L(\d+)", 1).cast("int")
        high = F.coalesce(F.nullif(F.regexp_extract(ref, r"-L(\d+)$", 1), F.lit("")).cast("int"), low)
        return F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.concat(source, F.lit(":L"), padded(n, 3)))

    return F.flatten(F.transform(refs, spell))


def tier(amount: Column, limits: list[tuple[int, float]]) -> Column:
    """Value of the first tier whose limit is not exceeded; an error beyond the last."""
    out = None
    for limit, value in limits:
        out = F.when(amount <= limit, F.lit(value)) if out is None else out.when(amount <= limit, F.lit(value))
    return out.when(amount.isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.lit("amount beyond the last tier")).cast("double"))


def hash_order(seed: str, *keys: str) -> Column:
    """A stable pseudo-random key."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in keys]), 256)


def instant_of(iso: Column) -> Column:
    """Milliseconds since the epoch of an ISO time in any spelling, with its offset; without one it is UTC. Null if it is none."""
    zoned = F.when(iso.rlike(r"(Z|[+-]\d\d:?\d\d)$"), iso).otherwise(F.concat(iso, F.lit("Z")))
    return F.unix_millis(zoned.try_cast("timestamp"))
