"""Personal data: exact patterns, then bootstrapped contextual extraction, with DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four kinds, judged after matching (KINDS). Their places come from
marks that regexp_replace sets around each match; the patterns are written possessively, so no text makes them quadratic.

Bootstrapping: base spans are seed entities. The words around a seed (one and two before it, and the pair before and
after, each as far as it lies within AROUND characters) are its lexical patterns. Candidate instances are other tokens of
MIN_CHARS characters or more with a digit or an @, and runs of up to six digit groups between single spaces. In each
round Spark scores the graph of patterns and instances: a pattern's confidence for a kind is the number of different
entities of the kind it precedes over all different instances in it plus one; an instance's score is the noisy-or of its
patterns' confidences. Patterns need SUPPORT different entities and CONFIDENCE; instances that reach SCORE become
entities, lend support in the next round wherever their text stands, and are added to the spans with the kind of the best pattern. Confidence only
grows from round to round, and rounds end when no instance is added.

Defined cases: a null or empty text has no spans; rows without an id are judged and returned like others; repeated rows are judged alike, and count as one entity; an empty table gives
no rows; other columns are ignored. Candidates never overlap a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import forget, stored

# The kinds in order, with their patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
OPEN, CLOSE, GROUP, AROUND = "\x01", "\x02", 256, 128
SUPPORT, CONFIDENCE, SCORE, MIN_CHARS = 3, 0.75, 0.9, 6
RUN = r"(?<!\S)[(]?[0-9][0-9().-]*+(?: [0-9().-]++){1,5}+(?<=[0-9])(?![^\s.,;:!?)\"'])"
CANDIDATE = rf"{RUN}|(?<!\S)(?=\S*[0-9@])\S{{{MIN_CHARS - 1},}}[^\s.,;:!?)\"']"


def marked_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the pattern's matches; start and end count code points."""
    plain = F.translate(text, OPEN + CLOSE, "\x03\x03")
    parts = F.split(F.regexp_replace(plain, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    long = lambda x: x.cast("long")
    size = lambda x: long(F.length(x)) - 1
    body = F.slice(parts, F.lit(2), F.size(parts) - 1)
    # running sums in groups of GROUP parts, then over groups
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 2) / GROUP).cast("int")), lambda g: F.slice(body, g * GROUP + 1, F.lit(GROUP)))
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)")

    def step(acc: Column, x: Column) -> Column:
        stop = long(F.instr(x, CLOSE)) - 1
        item = F.struct(acc["at"].alias("start"), (acc["at"] + stop).alias("end"), F.substring_index(x, CLOSE, 1).alias("match"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    inner = F.transform(groups, lambda g: F.aggregate(g, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step))
    first = long(F.length(F.element_at(parts, 1)))
    begins = F.aggregate(inner, F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out")), lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    shifted = F.transform(F.arrays_zip(inner.alias("g"), begins.alias("b")), lambda z: F.transform(z["g"]["out"], lambda y: F.struct((y["start"] + z["b"]).alias("start"), (y["end"] + z["b"]).alias("end"), y["match"].alias("match"))))
    return F.when(F.size(parts) > 1, F.flatten(shifted)).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, match>> of all base spans by start, then kind as listed."""
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,match:string>>)")
    worth = {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]")}

    def of(number: int, kind: str) -> Column:
        good = F.filter(marked_spans(text, PATTERNS[kind]), lambda x: _valid(kind, x["match"]))
        named = F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end"), x["match"].alias("match")))
        return F.when(worth[kind], named).otherwise(none)

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def _label(x: Column) -> Column:
    return F.concat(_name(x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))


def _found(docs: DataFrame) -> DataFrame:
    """row, doc_id, base spans and candidate spans of every row, stored without the texts."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", "text", base_spans(text).alias("base"))
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,match:string>>)")
    tokens = F.when(text.rlike("[0-9@]"), marked_spans(text, CANDIDATE)).otherwise(none)
    rows = rows.withColumn("tokens", F.filter(tokens, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))))

    def around(x: Column, kind: Column) -> Column:
        begin = F.greatest(x["start"] - AROUND, F.lit(0))
        left = F.substring(text, (begin + 1).cast("int"), (x["start"] - begin).cast("int"))
        right = F.substring(text, (x["end"] + 1).cast("int"), F.lit(AROUND))
        two, after = F.regexp_extract(F.lower(left), r"(?:^|\s)((?:\S+\s+)?\S+)\s*$", 1), F.regexp_extract(F.lower(right), r"^\s*(\S+)", 1)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), F.lower(x["match"]).alias("name"), two.alias("two"), after.alias("after"))

    every = F.concat(F.transform("base", lambda x: around(x, x["kind"])), F.transform("tokens", lambda x: around(x, F.lit(None).cast("int"))))
    rows = rows.withColumn("near", F.when(F.size("base") + F.size("tokens") > 0, every))
    slim = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return stored(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", slim.alias("base"), "near"), "pii-spans")


def bootstrap(found: DataFrame) -> DataFrame:
    """row, start, kind, end of the discovered identifiers."""
    each = found.where("near is not null").select("row", F.explode("near").alias("x")).select("row", "x.*")
    one, two, after = F.regexp_extract("two", r"(\S+)$", 1), F.when(F.col("two").rlike(r"\s"), F.col("two")).otherwise(""), F.col("after")
    patterns = F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two), F.concat(F.lit("b "), one, F.lit(" _ "), after))
    useful = F.filter(patterns, lambda p: (one != "") & (p != "2 ") & ~p.endswith(" _ "))
    edges = stored(each.select("row", "start", "end", "kind", "name", F.explode(useful).alias("pattern")), "pii-edges")
    spread = edges.groupBy("pattern").agg(F.countDistinct("name").alias("all"))
    known, n = None, 0
    while True:
        entities = edges.where("kind is not null").select("pattern", "kind", "name")
        if known is not None:
            entities = entities.union(edges.where("kind is null").drop("kind").join(known.select("name", "kind").distinct(), "name").select("pattern", "kind", "name"))
        trusted = entities.groupBy("pattern", "kind").agg(F.countDistinct("name").alias("own")).where(F.col("own") >= SUPPORT).join(spread, "pattern").select("pattern", "kind", (F.col("own") / (F.col("all") + 1)).alias("sure")).where(F.col("sure") >= CONFIDENCE)
        scored = edges.where("kind is null").drop("kind").join(trusted, "pattern").groupBy("row", "start", "end", "name", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("sure"))))).alias("score")).where(F.col("score") >= SCORE)
        last, known = known, stored(scored.groupBy("row", "start").agg(F.max(F.struct("score", (-F.col("kind")).alias("less"), "end", "name")).alias("best")).select("row", "start", (-F.col("best.less")).alias("kind"), F.col("best.end").alias("end"), F.col("best.name").alias("name")), "pii-known")
        found = known.count()
        if found == n:
            return known
        forget(last)
        n = found


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    found = _found(docs)
    more = bootstrap(found).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    joined = found.select("row", "doc_id", "base").join(more, "row", "left")
    both = F.array_sort(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))))
    text = lambda spans: F.array_join(F.transform(spans, _label), ",")
    return joined.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(both).alias("spans"))
