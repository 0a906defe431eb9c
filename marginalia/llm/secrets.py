"""Secret scan by linking the parts of a credential. Only SQL functions run on the texts.

Parts are found in every whole text, each kind leftmost and without overlaps:

* sure secrets, reported wherever they stand: ``assign`` (a value given to a secret's name),
  ``access`` (an access key id) and ``hex`` (a long run of hexadecimal digits);
* weak parts, which mean nothing alone: ``ident`` (a value given to a user, client or account
  name), ``weakval`` (a mixed value of 16 characters or more, however long, given to some other
  name or standing alone) and ``endpoint`` (a URL with a scheme that services use).

A scope is the stretch of text within ``reach`` code points of a part. Intervals of parts that meet
in a scope are linked: an identifier is reported if a secret or weak value stands in its scope, a
weak value if an identifier, access key id or endpoint does, an endpoint if both an identifier and
a secret or weak value do.

Everything happens in the row of the document: matches and the text between them give the offsets.
Parts are sorted by place and run through once in each direction, which leaves beside every part the
nearest identifier, secret and endpoint in its scope. Neither rows nor pairs are shuffled and a hot
source is no burden.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.session import configure

BASE_KINDS = ("assign", "access", "hex")
WEAK_KINDS = ("ident", "weakval", "endpoint")
KINDS = (*BASE_KINDS, *WEAK_KINDS)
ROLES = {"value": ("assign", "hex", "weakval"), "name": ("ident", "access"), "endpoint": ("endpoint",)}
REACH = 200
BLOCK = 64  # states gathered in one array

# fixed values: the patterns of the parts
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
IDENT = r"""(?i:user(?:_?name|_?id)?|login|client_?id|account_?(?:id|name)?|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
WEAKVAL = r"[A-Za-z0-9+/_=-]{16,}+"  # whole runs; that they hold a digit and a letter is asked afterwards
ENDPOINT = r"""(?:https?|s3|ftp|sftp|ssh|amqp|redis|mongodb|mysql|postgres(?:ql)?|jdbc:[a-z]+)://[^\s"'<>]{4,}"""


def _mixed(value: Column) -> Column:
    """Length of a value that has a digit and a letter, else 0."""
    return F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), F.length(value)).otherwise(0)


def _running(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The states that ``step`` goes through, one after each item. First only the state at the end
    of every block is found, then each block gathers its own states from there, so no long array is
    copied at every item."""

    def ends(parts: Column) -> Column:
        return F.aggregate(
            parts, F.array(zero), lambda out, part: F.concat(out, F.array(F.aggregate(part, F.element_at(out, -1), step)))
        )

    def states(part: Column, before: Column) -> Column:
        gathered = F.aggregate(part, F.array(before), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
        return F.slice(gathered, F.lit(2), F.size(part))

    def blocks(bound: Column) -> Column:
        last = F.greatest(F.floor((F.size(bound) - 1) / BLOCK), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(bound, b * BLOCK + 1, F.lit(BLOCK)))

    def all_states(parts: Column) -> Column:
        return F.flatten(F.zip_with(parts, F.slice(ends(parts), F.lit(1), F.size(parts)), states))

    return X.bind(X.bind(items, blocks), all_states)


def _spans(text: Column, pattern: str, kind: str, group: int = 0, size: Callable[[Column], Column] = F.length) -> Column:
    """Array of (start, end, kind, size of the group) of all matches: a match begins after the
    pieces and matches before it."""
    p = F.lit(pattern)
    raw = F.struct(
        F.regexp_extract_all(text, p, F.lit(0)).alias("whole"), F.regexp_extract_all(text, p, F.lit(group)).alias("inner"),
        F.split(text, pattern, -1).alias("between"),
    )

    def placed(m: Column) -> Column:
        sizes = F.zip_with(
            F.slice(m["between"], 1, F.size(m["whole"])), F.zip_with(m["whole"], m["inner"], lambda w, g: F.struct(F.length(w).alias("n"), size(g).alias("inner"))),
            lambda gap, x: F.struct(F.length(gap).alias("gap"), x["n"].alias("n"), x["inner"].alias("inner")),
        )
        return X.bind(sizes, lambda ms: F.zip_with(
            ms, _running(ms, F.lit(0), lambda at, x: at + x["gap"] + x["n"]),
            lambda x, end: F.struct((end - x["n"]).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["inner"].alias("inner")),
        ))

    return F.when(text.rlike(pattern), X.bind(raw, placed)).otherwise(_no_spans())


def _no_spans() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,inner:int>>")


def _outside(weak: Column, sure: Column) -> Column:
    """Weak values that no sure secret overlaps: along the text, at the end of each the farthest
    end of the secrets that began before is known."""
    event = lambda pos, rank, x: F.struct(pos.alias("pos"), F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["inner"].alias("inner"))
    events = F.sort_array(F.concat(F.transform(weak, lambda x: event(x["end"], 0, x)), F.transform(sure, lambda x: event(x["start"], 1, x))))

    def clear(es: Column) -> Column:
        reached = _running(es, F.lit(0), lambda far, x: F.when(x["rank"] == 1, F.greatest(far, x["end"])).otherwise(far))
        met = F.zip_with(es, reached, lambda x, far: F.struct(x.alias("x"), ((x["rank"] == 0) & (far <= x["start"])).alias("clear")))
        return F.transform(F.filter(met, lambda m: m["clear"]), lambda m: F.struct(
            m["x"]["start"].alias("start"), m["x"]["end"].alias("end"), F.lit("weakval").alias("kind"), m["x"]["inner"].alias("inner")
        ))

    return X.bind(events, clear)


def _neighbours(parts: Column, forward: bool) -> Column:
    """Per part, by start and kind, the nearest part of each role that ends before it begins, or,
    backward, that begins where it ends or later. One run over the parts sorted by place."""
    place = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    sign = 1 if forward else -1

    roles = [(r, i) for i, r in enumerate(ROLES)]

    def events(x: Column) -> Column:
        seen, asks = (x["end"], x["start"]) if forward else (x["start"], x["end"])
        role = F.lit(-1)
        for r, i in roles:
            role = F.when(x["kind"].isin(*ROLES[r]), i).otherwise(role)
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))
        one = lambda pos, rank, role: F.struct(
            (pos * sign).alias("pos"), F.lit(rank).alias("rank"), x["start"].alias("start"), place(x["kind"]).alias("place"), role.alias("role"), span.alias("span")
        )
        return F.array(one(seen, 0, role), one(asks, 1, F.lit(-1)))

    none = F.lit(None).cast("struct<start:int,end:int,kind:string>")
    zero = F.struct(*[none.alias(r) for r in ROLES])

    def step(state: Column, x: Column) -> Column:
        found = F.struct(*[F.when(x["role"] == i, x["span"]).otherwise(state[r]).alias(r) for r, i in roles])
        return F.when(x["role"] < 0, state).otherwise(found)

    def run(es: Column) -> Column:
        met = F.zip_with(es, _running(es, zero, step), lambda x, s: F.struct(
            x["start"].alias("start"), x["place"].alias("place"), x["span"]["end"].alias("end"), x["span"]["kind"].alias("kind"), x["rank"].alias("rank"), s.alias("near")
        ))
        return F.sort_array(F.filter(met, lambda m: m["rank"] == 1))

    return X.bind(F.sort_array(F.flatten(F.transform(parts, events))), run)


def _linked(parts: Column, reach: int) -> Column:
    """All parts by start, then kind, each with the nearest part of every role in its scope."""

    def nearest(part: Column, before: Column, after: Column, role: str) -> Column:
        left, right = before["near"][role], after["near"][role]
        from_left, from_right = part["start"] - left["end"], right["start"] - part["end"]
        here, there = F.coalesce(from_left <= reach, F.lit(False)), F.coalesce(from_right <= reach, F.lit(False))
        return F.when(here & (~there | (from_left <= from_right)), left).when(there, right)

    def join(ps: Column) -> Column:
        both = F.arrays_zip(_neighbours(ps, True).alias("b"), _neighbours(ps, False).alias("a"))
        return F.transform(both, lambda x: F.struct(
            x["b"]["start"].alias("start"), x["b"]["place"].alias("place"), x["b"]["end"].alias("end"), x["b"]["kind"].alias("kind"),
            *[nearest(x["b"], x["b"], x["a"], r).alias(r) for r in ROLES],
        ))

    return X.bind(parts, join)


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """All columns of ``docs``, ``secrets``, an array of (start, end, kind) by start, then kind
    as listed, and ``credentials``, an array of (value, name, endpoint) by the start of the value:
    every secret or weak value that an identifier or endpoint stands near, with the nearest of
    each; columns of those names are replaced.

    Null texts count as empty; texts without parts have empty arrays. Rows that repeat are
    searched each; an empty table gives no rows. Work grows in proportion to the length of a text
    and the number of its parts.
    """
    configure(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # the columns of docs travel in one struct, so their names cannot clash with those here
    parts = (
        docs.select(F.struct("*").alias("row"), "text").withColumn("_assign", F.filter(_spans(text, ASSIGN, "assign", 2), lambda x: x["inner"] >= 6))
        .withColumn("_access", F.filter(_spans(text, ACCESS, "access"), lambda x: x["inner"] >= 20))
        .withColumn("_hex", _spans(text, HEX, "hex"))
        .withColumn("_ident", _spans(text, IDENT, "ident", 1))
        .withColumn("_endpoint", _spans(text, ENDPOINT, "endpoint"))
    )
    parts = parts.withColumn("_sure", F.concat("_assign", "_access", "_hex")).withColumn("_alone", F.size("_ident") + F.size("_access") + F.size("_endpoint") == 0)
    # a weak value needs a partner, so it is looked for only where there is one
    mixed = F.filter(_spans(text, WEAKVAL, "weakval", size=_mixed), lambda x: x["inner"] > 0)
    parts = parts.withColumn("_weakval", F.when(~F.col("_alone"), _outside(mixed, F.col("_sure"))).otherwise(_no_spans()))
    known = F.transform(F.concat("_sure", "_ident", "_weakval", "_endpoint"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    order = F.array(*[F.lit(k) for k in KINDS])
    none = F.lit(None).cast("struct<start:int,end:int,kind:string>")
    single = F.sort_array(F.transform(known, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(order, x["kind"]).alias("place"), x["end"].alias("end"), x["kind"].alias("kind"), *[none.alias(r) for r in ROLES]
    )))
    parts = parts.withColumn("_linked", F.when(F.col("_alone"), single).otherwise(_linked(known, reach)))

    has = lambda x, role: x[role].isNotNull()
    told = F.filter("_linked", lambda x: (
        F.when(x["kind"] == "ident", has(x, "value"))
        .when(x["kind"] == "weakval", has(x, "name") | has(x, "endpoint"))
        .when(x["kind"] == "endpoint", has(x, "name") & has(x, "value"))
        .otherwise(True)
    ))
    span = lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["kind"].alias("kind"))
    owned = F.filter("_linked", lambda x: x["kind"].isin(*ROLES["value"]) & (has(x, "name") | has(x, "endpoint")))
    part = lambda x, role: F.when(has(x, role), span(x[role])).alias(role)
    credentials = F.transform(owned, lambda x: F.struct(span(x).alias("value"), part(x, "name"), part(x, "endpoint")))
    return parts.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in ("secrets", "credentials")],
        F.transform(told, span).alias("secrets"), credentials.alias("credentials"),
    )


def _spelled(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


def credentials_text(found: Column) -> Column:
    """Credentials as value, name and endpoint joined by plus signs, comma-joined."""
    return F.array_join(F.transform(found, lambda c: F.concat_ws("+", *[F.when(c[r].isNotNull(), _spelled(c[r])) for r in ROLES])), ",")


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, _spelled), ",")


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by its kind in angle brackets, the
    first of spans that overlap winning."""
    found = find_secrets(docs.select("text", F.struct("*").alias("row")), reach)
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    pieces = F.aggregate(
        "secrets",
        start,
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("<"), x["kind"], F.lit(">")).alias("out"),
            ),
        ).otherwise(s),
        lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    changed = F.when(F.size("secrets") > 0, pieces).otherwise(F.col("text"))
    return found.select(*[changed.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
