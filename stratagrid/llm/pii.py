"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are kept on their checks alone. The method adds spans of two
more kinds: ``iban`` (mod-97) and ``ssn`` (a bare pattern that only counts with a telling word within
``NEAR`` characters). All of it is DataFrame expressions.

Spark gives matched strings but no positions; ``split`` by the same expression gives what lies
between them, so running lengths of both are the positions, in code points. They are summed by a
window over the (few) matches of a row, so a text with very many matches costs no more than linear.

The expressions are the base ones, written so that Java's matcher neither recurses per character nor
tries again inside a run it has read: a card's digits are matched as the whole run it would be part
of (14 to 19 digits, no digit before or behind), which is what matching greedily and dropping other
lengths gives.

An account number's end can't be told by an expression, as words in capitals and numbers may follow.
Its expression only finds starts (a match of no width, so starts may lie within each other's reach)
and captures all that could belong to it. Of the ends in it that no letter or digit follows, those of
the country's length count; for a country that ``LENGTHS`` lacks, those that leave the number compact
or in groups of four, and the farthest. Mod-97 decides, and the longest number that passes is the span.

Defined results: a null text is empty; texts without a match have counts 0, the digest of no bytes
and an empty ``spans``; repeated rows each get a row; an empty table gives an empty table; other
columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Characters of an account number by country: the registry of ISO 13616.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What a text must hold at least before the expression is tried on it.
CHEAP = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.rlike(t, F.lit(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")),
    "phone": lambda t: F.rlike(t, F.lit(r"\+[0-9]")),
    "iban": lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]")),
    "ssn": lambda t: F.rlike(t, F.lit(r"[0-9]-[0-9]{2}-[0-9]")),
}
#: Score of a confirmed span, words that raise it, and the score an added span needs.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|contact|write|mailto",
    "ip": "address|server|host|login",
    "card": "card|visa|master|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|telefon|llame",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance|tax",
}
LIFT = 0.3
ACCEPT = 0.5
NEAR = 40
EMPTY = "array<string>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*(F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes ISO 7064 mod 97-10."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def account_in(captured: Column) -> Column:
    """The longest account number that a captured run begins with; null if there is none."""
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    code = F.left(captured, F.lit(2))
    length = F.coalesce(*(F.when(code.isin(codes.split()), n) for n, codes in LENGTHS.items()))
    closed = lambda e: F.substr(captured, e + 1, F.lit(1)).isin("", " ") & (F.substr(captured, e, F.lit(1)) != " ")
    farthest = F.length(F.regexp_extract(captured, "^[A-Z0-9 ]*(?![A-Za-z0-9])", 0))
    regular = lambda x: x.rlike("^(?:[A-Z0-9]+|[A-Z0-9]{4}(?: [A-Z0-9]{4})*(?: [A-Z0-9]{1,4})?)$") | (F.length(x) == farthest)
    fits = lambda x: F.when(length.isNotNull(), F.length(bare(x)) == length).otherwise(F.length(bare(x)).between(15, 34) & regular(x))
    ends = F.filter(F.sequence(F.length(captured), F.lit(15)), closed)
    able = F.filter(F.transform(ends, lambda e: F.left(captured, e)), lambda x: ~x.rlike("[a-z]") & fits(x))
    return F.get(F.filter(able, lambda x: mod97(bare(x))), F.lit(0))


def confirmed(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(found, r"\."), lambda p: F.coalesce(F.substr(F.concat(F.lit("00"), F.ltrim(p, F.lit("0"))), F.lit(-3)).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def proposals(kind: str, text: Column) -> Column:
    """An array of each match of a kind with the length of the gap before it, its own, its check and its score."""
    if kind == "iban":
        return accounts(text)
    pattern = F.lit(PATTERNS[kind])
    cheap = CHEAP[kind](text)
    none = F.array().cast(EMPTY)
    found = F.when(cheap, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)
    gaps = F.when(cheap, F.split(text, PATTERNS[kind], -1)).otherwise(none)
    gap = lambda i: F.coalesce(F.get(gaps, i), F.lit(""))
    return F.transform(found, lambda m, i: proposal(kind, i, F.length(gap(i)), F.length(m), confirmed(kind, m), gap(i), gap(i + 1)))


def proposal(kind: str, i: Column, gap: Column, n: Column, ok: Column, before: Column, behind: Column) -> Column:
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(behind, F.lit(NEAR))))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        i.alias("i"),
        gap.cast("long").alias("gap"),
        n.cast("long").alias("n"),
        ok.alias("ok"),
        (F.lit(PRIOR[kind]) + F.when(near.rlike(CONTEXT[kind]), LIFT).otherwise(0.0)).alias("score"),
    )


def accounts(text: Column) -> Column:
    """``proposals`` of account numbers: a gap is counted from the start before, less what that one's number took.

    A blank is put before the text, as ``split`` makes no gap of a match of no width at the very start.
    """
    kind, none = "iban", F.array().cast(EMPTY)
    cheap = CHEAP[kind](text)
    runs = F.when(cheap, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(1))).otherwise(none)
    found = F.transform(runs, account_in)
    gaps = F.when(cheap, F.split(F.concat(F.lit(" "), text), PATTERNS[kind], -1)).otherwise(none)
    gap = lambda i: F.coalesce(F.get(gaps, i), F.lit(""))
    n = lambda m: F.coalesce(F.length(m), F.lit(0))
    back = lambda i: F.when(i > 0, n(F.get(found, i - 1))).otherwise(1)
    behind = lambda i, m: F.substr(gap(i + 1), n(m) + 1)
    return F.transform(found, lambda m, i: proposal(kind, i, F.length(gap(i)) - back(i), n(m), m.isNotNull(), gap(i), behind(i, m)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (of the input), kind, start, end, score of every accepted span; one row of nulls for a text without."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text"))
    found = rows.select("doc_id", "row", F.concat(*(proposals(k, F.col("text")) for k in KINDS)).alias("found"))
    each = found.select("doc_id", "row", F.inline_outer("found")).repartition("row")
    upto = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))
    good = F.col("ok") & ((F.col("kind") < len(BASE)) | (F.col("score") >= ACCEPT))
    keep = lambda c: F.when(good, F.col(c))
    return placed.select("doc_id", "row", *(keep(c).alias(c) for c in ("kind", "start", "end", "score")))


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, the digest of base spans, all spans and the highest score."""
    span = F.struct("start", "kind", "end")
    by = (
        spans(docs)
        .groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            *(F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
            F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("found"),
            F.max("score").alias("top_score"),
        )
    )
    names = F.array(*(F.lit(k) for k in KINDS))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return by.select(
        "doc_id",
        *(F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        *(F.col(f"n_{k}").cast("long").alias(f"n_{k}") for k in ADDED),
        "top_score",
    )
