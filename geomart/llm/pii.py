"""Personal data by fixed forms and by bootstrapped context, with built-in Spark functions only.

Fixed forms give the base spans. They are the seeds: identifier-like places of the corpus (a looser form of each kind)
stand in lexical contexts, the words before and after them. Contexts are patterns, values are instances, and both are
scored in turn over their graph: a pattern by the trust in its instances, an instance by its best patterns. Patterns that
stay near certain and that many distinct seeds support mark the unseen values they surround.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, join_unique, marked

#: Fixed forms, written without backtracking; a match can only begin where a run of its first characters begins or the last match ended.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same kinds: places that may hold an identifier.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}+(?:[.:\x20-][0-9]{1,3}+){3}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z+])[0-9](?:[\x20.-]?[0-9]){11,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])",
}
#: Characters of context on either side; a word that isn't whole within them is no part of a pattern.
CONTEXT = 48
UNSEEN = "array<struct<kind:string,begin:int,end:int>>"
SPAN = "struct<begin:int,end:int,value:string,left:string,right:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The array of results (of type `kind`) of a fold over items: step(state, item) gives the next state and the item's result.

    Arrays grow by copies, so the fold goes over chunks of about the root of the number of items: the copies then grow
    with its power of 1.5 only.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, item: Column) -> Column:
        after, result = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(result)).alias("out"))

    def chunk(acc: Column, held: Column) -> Column:
        start = F.struct(F.element_at(acc, -1)["state"].alias("state"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(held, start, one)))

    def whole(held: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(held).cast("double"))).cast("int"))
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(held) / size).cast("int") - 1)), lambda k: F.slice(held, k * size + 1, size))
        done = F.aggregate(chunks, F.array(F.struct(state.alias("state"), none.alias("out"))), chunk)
        return F.flatten(F.transform(done, lambda x: x["out"]))

    return let(items, whole)


def located(text: Column, form: str) -> Column:
    """array of (begin, end, value, left, right) of the form's matches: code points from 0, and the text around, up to the next match."""

    def tail(gap: Column) -> Column:
        near = F.right(gap, F.lit(CONTEXT))
        return F.when(F.length(gap) > CONTEXT, F.regexp_replace(near, r"^\S+", "")).otherwise(near)

    def head(gap: Column) -> Column:
        near = F.left(gap, F.lit(CONTEXT))
        return F.when(F.length(gap) > CONTEXT, F.regexp_replace(near, r"\S+$", "")).otherwise(near)

    def around(x: Column) -> Column:
        return F.struct(x["value"].alias("value"), F.length(x["before"]).alias("gap"), tail(x["before"]).alias("left"), head(x["after"]).alias("right"))

    def places(s: Column) -> Column:
        return F.transform(s["values"], lambda v, i: let(F.struct(v.alias("value"), F.get(s["gaps"], i).alias("before"), F.get(s["gaps"], i + 1).alias("after")), around))

    items = let(F.struct(F.split(text, form, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("values")), places)

    def step(at: Column, i: Column) -> tuple[Column, Column]:
        begin = at + i["gap"]
        end = begin + F.length(i["value"])
        return end, F.struct(begin.alias("begin"), end.alias("end"), i["value"].alias("value"), i["left"].alias("left"), i["right"].alias("right"))

    return running(items, F.lit(0), SPAN, step)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind's form is one."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(16, 19), F.call_function("luhn_check", digits(value))).otherwise(F.lit(False))
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def _true_of(kind: str):
    return lambda x: holds(kind, x["value"])


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def _where(text: Column, kind: str, form: str, loose: bool) -> Column:
    """located(), left out for texts that a plain test shows to have no such place."""
    may = {"email": text.contains("@") | F.lower(text).rlike(r"[(\[]at[)\]]") if loose else text.contains("@"), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": text.rlike("[0-9]") if loose else text.contains("+")}
    return F.when(may[kind], located(text, form)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _base(text: Column, kind: str, loose: bool = False) -> Column:
    return F.filter(_where(text, kind, FORMS[kind], loose), _true_of(kind))


def base_spans(docs: DataFrame, loose: bool = False) -> DataFrame:
    """doc_id, text_key and, for each kind, an array of (begin, end, value, left, right): `email` and so on; with `loose` also `loose_email` and so on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = [_where(text, k, f, True).alias(f"loose_{k}") for k, f in LOOSE.items()] if loose else []
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.encode(text, "UTF-8")).alias("text_key"), *[_base(text, k, loose).alias(k) for k in FORMS], *wide)


def instances(spans: DataFrame) -> DataFrame:
    """text_key, kind, begin, end, value, seed, left, right of every identifier-like place, once for equal texts."""
    one = spans.dropDuplicates(["text_key"])
    parts = []
    known = F.concat(*[F.transform(k, lambda s: F.struct(s["begin"], s["end"])) for k in FORMS])
    for kind in FORMS:
        unseen = F.transform(F.filter(f"loose_{kind}", lambda x: ~F.exists(known, lambda s: (s["begin"] < x["end"]) & (s["end"] > x["begin"]))), lambda x: F.struct(x["begin"], x["end"], x["value"], x["left"], x["right"], F.lit(False).alias("seed")))
        seeds = F.transform(kind, lambda x: F.struct(x["begin"], x["end"], x["value"], x["left"], x["right"], F.lit(True).alias("seed")))
        parts.append(one.select("text_key", F.lit(kind).alias("kind"), F.explode(F.concat(seeds, unseen)).alias("x")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("text_key", "kind", F.col("x.begin"), F.col("x.end"), F.col("x.value"), F.col("x.left"), F.col("x.right"), F.col("x.seed"))


def placed_patterns(found: DataFrame) -> DataFrame:
    """text_key, kind, begin, end, plain, seed, pattern: the lexical patterns around each place. A pattern is the word or two words before, or the word before and the one after."""
    before = F.regexp_extract_all(F.lower("left"), F.lit(r"\S+"), F.lit(0))
    one = F.element_at(before, -1)
    two = F.when(F.size(before) > 1, F.concat_ws(" ", F.element_at(before, -2), one))
    after = F.regexp_extract(F.lower("right"), r"\S+", 0)
    kinds = F.array(F.concat(F.lit("1:"), one), F.concat(F.lit("2:"), two), F.when(after != "", F.concat(F.lit("3:"), one, F.lit(" _ "), after)))
    plain = F.lower(F.regexp_replace("value", r"[\x20().-]", ""))
    return found.filter(F.size(before) > 0).select("text_key", "kind", "begin", "end", plain.alias("plain"), "seed", F.explode(F.array_compact(kinds)).alias("pattern"))


def patterns(placed: DataFrame) -> DataFrame:
    """kind, pattern, value, seed: the edges of the graph, each once."""
    return placed.groupBy("kind", "pattern", F.col("plain").alias("value")).agg(F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame, rounds: int = 3, least_seeds: int = 8, sure: float = 0.9, prior: float = 1.0) -> DataFrame:
    """kind, pattern of the patterns that mark unseen values; edges on storage.

    A pattern's score is the sum of trust in its instances over their number plus `prior`; a seed's trust is 1, another
    value's is the best score among its patterns with at least `least_seeds` distinct seeds. Values whose trust reaches
    `sure` count as seeds in the next round. A pattern with very many instances is joined without a shuffle of these.
    """
    unseen = cut(edges.filter("not seed"), "unseen")
    trusted = edges.withColumn("trust", F.col("seed").cast("double"))
    scores = None
    for _ in range(rounds):
        scores = cut(trusted.groupBy("kind", "pattern").agg((F.sum("trust") / (F.count("*") + F.lit(prior))).alias("score"), F.sum((F.col("trust") >= sure).cast("long")).alias("seeds")).filter(F.col("seeds") >= least_seeds), "patterns")
        best = join_unique(unseen, scores, ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("score").alias("best")).filter(F.col("best") >= sure)
        trusted = join_unique(edges, cut(best, "trusted"), ["kind", "value"], "left").withColumn("trust", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0)))).drop("best")
    return scores.filter(F.col("score") >= sure).select("kind", "pattern")


def discovered(found: DataFrame, **options) -> DataFrame:
    """text_key, kind, begin, end of the unseen places that stand next to a pattern that bootstrap() keeps; the same value elsewhere isn't one."""
    placed = cut(placed_patterns(found), "placed")
    kept = bootstrap(cut(patterns(placed), "edges"), **options)
    unseen = cut(placed.filter("not seed").select("text_key", "kind", "begin", "end", "pattern"), "unseen")
    return join_unique(unseen, kept, ["kind", "pattern"]).select("text_key", "kind", "begin", "end").distinct()


def _joined(parts: list[Column]) -> Column:
    return F.array_join(F.concat(*parts), ",")


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x["begin"].cast("string"), F.lit(":"), x["end"].cast("string")))


def with_discovered(docs: DataFrame, **options) -> DataFrame:
    """base_spans of each row and `unseen`: array of (kind, begin, end) that context adds."""
    spans = cut(base_spans(docs, loose=True), "spans")
    more = discovered(cut(instances(spans), "instances"), **options).groupBy("text_key").agg(F.collect_list(F.struct("kind", "begin", "end")).alias("unseen"))
    none = F.array().cast(UNSEEN)
    return join_unique(spans.select("doc_id", "text_key", *FORMS), cut(more, "unseen"), ["text_key"], "left").withColumn("unseen", F.coalesce("unseen", none))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_unseen.

    A null text counts as empty and has no spans. Equal texts have equal spans; an empty table gives an empty table;
    columns beside doc_id and text are not read. A text's spans are gathered in one row, so memory is bounded by the text.
    """
    d = with_discovered(docs, **options)
    both = {k: F.array_sort(F.concat(F.transform(k, lambda x: F.struct(x["begin"], x["end"])), F.transform(F.filter("unseen", _of_kind(k)), lambda x: F.struct(x["begin"], x["end"])))) for k in FORMS}
    return d.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in FORMS],
        F.sha2(_joined([_named(k, F.col(k)) for k in FORMS]), 256).alias("base_sha256"),
        _joined([_named(k, both[k]) for k in FORMS]).alias("spans"),
        F.size("unseen").cast("long").alias("n_unseen"),
    )


def _with_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["begin"].alias("begin"), x["end"].alias("end"))


def covered(spans: Column) -> Column:
    """array of (begin, end, kind) that don't overlap: spans by begin, the longer first; of one that overlaps those before only the part after them stays."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["begin"].alias("begin"), (-x["end"]).alias("least"), x["kind"].alias("kind"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = -x["least"]
        return F.greatest(at, end), F.struct(F.greatest(at, x["begin"]).alias("begin"), end.alias("end"), (x["begin"] < at).alias("follows"), x["kind"].alias("kind"))

    return F.filter(running(ordered, F.lit(0), "struct<begin:int,end:int,follows:boolean,kind:string>", step), lambda x: x["begin"] < x["end"])


def masked(text: Column, spans: Column) -> Column:
    """The text with each span of covered() replaced by [EMAIL] and so on; a part that continues another span is removed.

    Spans are cut from slices of the text, about as many as the root of their number, since finding a place in a string
    costs its distance from the beginning.
    """
    n = F.size(spans)
    size = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    end_of = lambda i: F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))

    def group(k: Column) -> Column:
        held, start = F.slice(spans, k * size + 1, size), end_of(k * size)
        part = text.substr(start + 1, F.element_at(held, -1)["end"] - start)

        def one(x: Column, i: Column) -> Column:
            last = F.coalesce(F.get(held, i - 1)["end"], start)
            return F.concat(part.substr(last - start + 1, x["begin"] - last), F.when(x["follows"], F.lit("")).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))

        return F.array_join(F.transform(held, one), "")

    groups = F.transform(F.sequence(F.lit(0), F.ceil(n / size).cast("int") - 1), group)
    return F.when(n > 0, F.concat(F.array_join(groups, ""), text.substr(end_of(n) + 1, F.length(text)))).otherwise(text)


def redact(docs: DataFrame, **options) -> DataFrame:
    """docs with personal data in `text` masked at its places and `n_chars`, where there is one, set to the new length. A null text stays null, an empty one empty.

    Fixed forms are found anew where the text lies; only texts to which context adds a place (told by a bitmap) are shuffled.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(UNSEEN)
    text_key, held, known = fresh(docs, "_key", "_spans", "_known")
    found = discovered(cut(instances(cut(base_spans(docs, loose=True), "spans")), "instances"), **options)
    more = cut(found.groupBy(F.col("text_key").alias(text_key)).agg(F.collect_list(F.struct("kind", "begin", "end")).alias(held)), "unseen")
    n = more.count()
    if n == 0:
        joined = docs.withColumn(held, none)
    else:
        told = marked(docs.withColumn(text_key, F.md5(F.encode(text, "UTF-8"))), more, [text_key], n, known)
        here = told.filter(~F.col(known)).select(*docs.columns, none.alias(held))
        joined = join_unique(told.filter(known).drop(known), more, [text_key], "left").select(*docs.columns, F.coalesce(held, none).alias(held)).unionByName(here)
    spans = F.concat(*[F.transform(_base(text, k), _with_kind(k)) for k in FORMS], F.col(held))
    out = joined.withColumn("text", F.when(F.col("text").isNotNull(), let(covered(spans), lambda s: masked(F.col("text"), s))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)
