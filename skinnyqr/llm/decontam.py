"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other
numbers or names has the same template.  Windows of eight template tokens
are hash-joined with the benchmark's; aligned windows of one item must cover
most of it or make a run of RUN windows, and the placeholders' values must map
consistently (one value to one value) between the item and the document.

An item is read in several views of the same tokens, each covered on its own:
T  the template; windows of mostly placeholders are left out
S  the template where a capitalised word that starts a sentence is a name too
L  names as lower-cased literals, so case and layout hide no copy
X  L, and windows of mostly placeholders by their values: verbatim copies
W  wide windows of the template, for items with windows that T leaves out
Items under LEAST_TOKENS tokens are found where they are a whole sentence or
line.  SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, free_name, save, save_counted

WINDOW = 8
#: Tokens of view W's windows, of which a quarter at least are literal.
WIDE = 2 * WINDOW
#: Items with fewer tokens are searched for as whole sentences or lines.
LEAST_TOKENS = 4
#: Share of an item's windows that must be found, in consistent alignments.
COVER = 0.6
#: Consecutive windows of an item that are reported whatever their share: WINDOW + 5 tokens.
RUN = 6
#: Window hashes that may be broadcast (8 bytes each); beyond it the join is shuffled.
MAX_BROADCAST = 4_000_000
NUMBER, NAME, UNIT, START = "\u0001", "\u0002", "\u0003", "\u0004"
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ounce ounces pound pounds ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur percent degrees"
).split()


#: Capitalised words that start sentences and are no names.
FUNCTION_WORDS = (
    "A An The This That These Those He She It They We You I His Her Its Their Our Your My There Here What Which Who Whom Whose When Where Why How "
    "If In On At By For From To Of With And But Or So Then As After Before While Each Every All Some One Is Are Was Were Do Does Did Has Have Had Can Not No"
).split()

#: Characters of scripts without blanks.  None is below U+0E00: the range spares most characters seven searches of the script table.
APART = r"[\u0e00-\x{10ffff}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]]"


#: White space as single characters, which make one bit set; a range or ``\\s`` would be one more test for every character.
BLANKS = r" \t\n\x0B\f\r\u00a0"
#: Letters that no name and no start can follow at once, in the same bit set: they need no look at their Unicode category.
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _marked(text: Column) -> Column:
    """The lower-cased text with a placeholder in front of numbers, names, units and starts."""
    raw = F.coalesce(text, F.lit(""))
    marked = raw.contains(NUMBER) | raw.contains(NAME) | raw.contains(UNIT) | raw.contains(START)
    t = F.when(marked, F.translate(raw, NUMBER + NAME + UNIT + START, "    ")).otherwise(raw)
    # a start may be the first character, but not stand behind blanks only; with a stop in front no pattern has to ask for the place
    t = F.when(F.substring(t, 1, 1).rlike(f"[{BLANKS}]"), t).otherwise(F.concat(F.lit("."), t))
    t = F.regexp_replace(t, rf"[{BLANKS}](?<=[\p{{Ll}},;][{BLANKS}])[{BLANKS}]*+(?=\p{{Lu}})", f" {NAME}")
    t = F.regexp_replace(t, rf"[^{LETTERS}{BLANKS},;{NAME}\p{{L}}\p{{N}}][{BLANKS}]*+(?=\p{{Lu}})(?!(?:{'|'.join(FUNCTION_WORDS)})(?![\p{{L}}\p{{N}}]))", f"$0{START}")
    t = F.lower(t)
    t = F.when(t.rlike(APART), F.regexp_replace(t, f"({APART})", " $1 ")).otherwise(t)
    number = F.regexp_replace(t, r"(^|[^\p{L}\p{N}])([0-9])", f"$1{NUMBER}$2")
    number = F.regexp_replace(number, rf"({NUMBER}[0-9.,]+[{BLANKS}]+)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$2$3")
    return F.when(raw.rlike("[0-9]"), number).otherwise(t)


def _tokens_of(marked: Column) -> Column:
    return F.array_remove(F.split(marked, rf"[^\p{{L}}\p{{N}}{NUMBER}-{START}]+"), "")


def template_tokens(text: Column) -> Column:
    """array<string> of lower-cased tokens; numbers, names, units and starts carry their placeholder as first character.

    A name is a capitalised word after a lower-case letter, comma or
    semicolon and white space; a start is another capitalised word that
    follows none of these and is no function word; a number is a token that
    starts with a digit; a unit is a unit word after a number.  A character
    of a script without blanks is a token.
    """
    return _tokens_of(_marked(text))


def _is_slot(t: Column) -> Column:
    return t < F.lit("\u0005")


def _view(t: Column, view: str) -> Column:
    """A token as a view reads it: literal without its placeholder, or with it; V has literals only."""
    literal, mark = F.substring(t, 2, 1 << 30), F.substring(t, 1, 1)
    if view == "S":
        return F.when(mark == START, F.concat(F.lit(NAME), literal)).otherwise(t)
    return F.when(mark.isin({"T": [START], "L": [START, NAME], "V": [START, NAME, NUMBER, UNIT]}[view]), literal).otherwise(t)


def _canonical(tokens, view: str) -> Column:
    """Hash of each token of a view; placeholders without their values."""

    def one(t):
        v = _view(t, view)
        # most tokens are literals: one comparison
        return F.when(_is_slot(t), F.xxhash64(F.when(_is_slot(v), F.substring(v, 1, 1)).otherwise(v))).otherwise(F.xxhash64(t))

    return F.transform(tokens, one)


def _window_hash(canon: Column, place: Column, size: int) -> Column:
    """Hash of the ``size`` elements from ``place`` on.

    For rows of exploded places, where it is compiled; the array functions,
    which need no explode, are interpreted.
    """
    return F.xxhash64(F.lit(size), *[F.get(canon, place + j if j else place) for j in range(size)])


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), template_tokens(F.col(text_col).cast("string")).alias("tokens"))
    return items.filter((F.size("tokens") > 0) & F.col("item_id").isNotNull())


def benchmark_classes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(cls, n_items, var, tokens, size): items of one template and one pattern of equal values are a class, of the same tokens a variant.

    cls and var are the smallest item ids; the variant cls stands for the template.
    """
    items = _items(benchmark, id_col, text_col).filter(F.size("tokens") >= LEAST_TOKENS)
    # a placeholder is numbered by the first place of its value
    plain = F.transform("tokens", lambda t: _view(t, "T"))
    pattern = F.transform(plain, lambda t: F.when(_is_slot(t), F.concat(F.substring(t, 1, 1), F.array_position(plain, t).cast("string"))).otherwise(t))
    items = items.withColumn("pattern", pattern)
    variants = items.groupBy("pattern", "tokens").agg(F.min("item_id").alias("var"))
    classes = items.groupBy("pattern").agg(F.min("item_id").alias("cls"), F.countDistinct("item_id").alias("n_items"))
    return variants.join(classes, "pattern").select("cls", "n_items", "var", "tokens", F.least(F.size("tokens"), F.lit(WINDOW)).alias("size"))


def _slots(view: str, size) -> Column:
    return F.size(F.filter(F.slice("tokens", F.col("q") + 1, size), lambda t: _is_slot(_view(t, view))))


def benchmark_windows(classes: DataFrame) -> DataFrame:
    """(cls, var, view, w, q, h): the windows of w tokens from place q on of each view."""
    parts = []
    for size in sorted(r[0] for r in classes.select("size").distinct().collect()):  # at most LEAST_TOKENS..WINDOW
        one = classes.filter(F.col("size") == size)

        def windows(view, of, w=size, one=one):
            src = one.filter("var = cls") if of in "TSW" else one
            src = src.select("cls", "var", "tokens", _canonical(F.col("tokens"), view).alias("canon"))
            src = src.select("cls", "var", "tokens", "canon", F.posexplode_outer("canon").alias("q", "first")).filter(F.col("q") + w <= F.size("canon"))
            src = src.withColumn("h", _window_hash(F.col("canon"), F.col("q"), w))
            return src.select("cls", "var", "tokens", F.lit(of).alias("view"), F.lit(w).alias("w"), "q", "h", _slots({"T": "T", "S": "T", "L": "L", "V": "L"}[view], w).alias("slots"))  # a start counts as a literal

        t, s, lit, val = windows("T", "T"), windows("S", "S"), windows("L", "L"), windows("V", "X")
        has = lambda marks: F.exists("tokens", lambda x: F.substring(x, 1, 1).isin(marks))
        parts += [t.filter("slots * 2 <= w"), s.filter(has([NAME, START]) & (F.col("slots") * 2 <= F.col("w"))), lit.filter(has([NAME, START, NUMBER]) & (F.col("slots") * 2 <= F.col("w")))]
        heavy = val.filter("slots * 2 > w")
        mixed = heavy.select("var").distinct()
        parts += [heavy, lit.filter("slots * 2 <= w").join(mixed, "var", "left_semi").withColumn("view", F.lit("X"))]
        if size == WINDOW:
            left_out = t.filter("slots * 2 > w").select("var").distinct()
            parts.append(windows("T", "W", WIDE).filter("(w - slots) * 4 >= w").join(left_out, "var", "left_semi"))
    out = None
    for p in parts:
        p = p.select("cls", "var", "view", "w", "q", "h")
        out = p if out is None else out.unionByName(p)
    return out


def document_windows(src: DataFrame, kinds: set[tuple[str, int]]) -> DataFrame:
    """(doc_id, th, p, h): the windows from place p on of each text (doc_id, text), for the benchmark's (view, w); th is the text's hash.

    A view's windows are made only for texts that it reads otherwise than the template.
    """
    marked = src.select("doc_id", F.xxhash64("text").alias("th"), _marked(F.col("text")).alias("m"))
    marks = {"S": START, "L": NAME, "V": NUMBER}
    tokens = marked.select("doc_id", "th", _tokens_of(F.col("m")).alias("tokens"), *[F.col("m").contains(m).alias(f"has{v}") for v, m in marks.items()])
    sizes = sorted({w for view, w in kinds if view != "W"})
    heavy = F.size(F.filter("tokens", lambda t: F.substring(t, 1, 1) == NUMBER)) * 4 > sizes[0]  # half of a window are numbers and their units
    needs = {"T": F.lit(True), "S": F.col("hasS"), "L": F.col("hasL"), "V": F.col("hasV") & heavy}
    views = [v for v in "TSLV" if v != "V" or any(k == "X" for k, _ in kinds)]
    canon = tokens.select("doc_id", "th", *[F.when(needs[v], _canonical(F.col("tokens"), v)).alias(f"c{v}") for v in views])
    lists = [(v, w) for v in views for w in sizes] + [("T", WIDE)] * (("W", WIDE) in kinds)
    # outer: a filter on the lists, pushed below the projections, would compute them again for every reference
    lists = F.explode_outer(F.array(*[F.struct(F.col(f"c{v}").alias("c"), F.lit(w).alias("w")) for v, w in lists])).alias("list")
    places = canon.select("doc_id", "th", lists).select("doc_id", "th", F.col("list.c").alias("c"), F.col("list.w").alias("w"))
    places = places.select("doc_id", "th", "c", "w", F.posexplode_outer("c").alias("p", "first")).filter(F.col("p") + F.col("w") <= F.size("c"))
    h = None
    for w in {w for _, w in kinds}:
        one = _window_hash(F.col("c"), F.col("p"), w)
        h = one if h is None else F.when(F.col("w") == w, one).otherwise(h)
    return places.select("doc_id", "th", "p", h.alias("h"))


def _short_found(src: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_items) of items under LEAST_TOKENS tokens that are a whole sentence or line."""
    literal = lambda df: F.concat_ws(" ", F.transform("tokens", lambda t: _view(t, "V")))
    own = items.withColumn("said", literal(items)).groupBy("said").agg(F.min("item_id").alias("item_id"), F.countDistinct("item_id").alias("n_items"))
    parts = src.select("doc_id", F.explode(F.split("text", r"[\n\r。！？]+|[.!?]+(?=[\s\p{P}]|$)")).alias("part"))
    parts = parts.select("doc_id", template_tokens(F.col("part")).alias("tokens")).filter(F.size("tokens").between(1, LEAST_TOKENS - 1))
    said = parts.select("doc_id", literal(parts).alias("said")).distinct()
    return said.join(broadcast_if_small(own, MAX_BROADCAST), "said").select("doc_id", "item_id", "n_items")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, n_items, matched, n_windows, reparameterised), a row per document and class of items found in it.

    item_id is the smallest of the n_items items that share the template and
    the pattern of its values; reparameterised is true if any value differs.
    matched and n_windows are of the view that is covered best.
    Null and empty texts contain nothing; null item ids and items without a
    token are not searched for; repeated rows are found once; rows with a
    null id are reported with a null doc_id.  Other columns are ignored.
    Empty tables give no rows.  The result is a written table.
    """
    with Scratch(docs.sparkSession) as keep:
        return save(_contaminated(docs, benchmark, id_col, text_col, item_id_col, item_text_col, keep), "contaminated")


def _contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, keep: Scratch) -> DataFrame:
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    classes, n_classes = keep.save_counted(benchmark_classes(benchmark, item_id_col, item_text_col), "classes")
    short, n_short = keep.save_counted(_items(benchmark, item_id_col, item_text_col).filter(F.size("tokens") < LEAST_TOKENS), "short")
    schema = "doc_id long, item_id long, n_items long, matched long, n_windows long, reparameterised boolean"
    out = _long_found(src, classes, keep) if n_classes else docs.sparkSession.createDataFrame([], schema)
    if not n_short:
        return out
    return out.unionByName(_short_found(src, short).selectExpr("doc_id", "item_id", "n_items", "1L AS matched", "1L AS n_windows", "false AS reparameterised"))


def _bounded(df: DataFrame, name: str, keep: Scratch) -> tuple[DataFrame, int, int]:
    """What broadcast_if_small takes of a table that is written, so that it is made once."""
    out, n = keep.save_counted(df, name)
    return out, MAX_BROADCAST, n


def _long_found(src: DataFrame, classes: DataFrame, keep: Scratch) -> DataFrame:
    save = keep.save
    windows = save(benchmark_windows(classes), "all_windows")
    kinds = {(r[0], r[1]) for r in windows.select("view", "w").distinct().collect()}  # at most 5 views of 5 sizes
    windows = windows.selectExpr("*", "count(*) OVER (PARTITION BY var, view) AS n_windows", "count(*) OVER (PARTITION BY h) AS df")
    windows = windows.selectExpr("*", "row_number() OVER (PARTITION BY var, view ORDER BY df, h, q) AS place")
    # an item whose windows are covered has at least one of its n - ceil(COVER n) + 1 rarest windows found
    # a run has the rarest of each RUN windows in a row
    windows = windows.selectExpr("*", f"min(place) OVER (PARTITION BY var, view ORDER BY q ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING) AS near")
    rarest = f"array_contains(collect_set(near) OVER (PARTITION BY var, view ORDER BY q ROWS BETWEEN {RUN - 1} PRECEDING AND CURRENT ROW), place)"
    windows = windows.selectExpr("cls", "var", "view", "w", "q", "h", "n_windows", f"place <= n_windows - ceil({COVER} * n_windows) + 1 OR {rarest} AS rare")
    windows = save(windows, "windows")

    sought = broadcast_if_small(*_bounded(windows.select("h").distinct(), "sought", keep))
    hits = document_windows(src, kinds).join(sought, "h").select("doc_id", "th", "p", "h")
    hits = save(hits.distinct(), "hits")

    cand = hits.join(windows.filter("rare").select("var", "view", "h"), "h").select("doc_id", "th", "var", "view").distinct()
    same = [F.col("hits.doc_id").eqNullSafe(F.col("cand.doc_id")), F.col("hits.th") == F.col("cand.th")]
    near = hits.alias("hits").join(cand.alias("cand"), same).select("hits.doc_id", "hits.th", "hits.p", "hits.h", "cand.var", "cand.view")
    aligned = near.join(windows, ["var", "view", "h"]).select("doc_id", "th", "var", "view", "w", "q", "n_windows", (F.col("p") - F.col("q")).alias("shift"))
    aligned = save(aligned.distinct(), "aligned")
    ends = [F.min("q").alias("q0"), F.max(F.col("q") + F.col("w")).alias("q1"), F.collect_set("q").alias("qs")]
    runs = aligned.groupBy("doc_id", "th", "var", "view", "n_windows", "shift").agg(*ends).withColumn("long", F.lit(False))
    # consecutive windows of full width, each run checked on its own
    rows = aligned.filter(f"w >= {WINDOW}").selectExpr("*", "q - row_number() OVER (PARTITION BY doc_id, th, var, view, shift ORDER BY q) AS run")
    rows = rows.groupBy("doc_id", "th", "var", "view", "n_windows", "shift", "run").agg(*ends).filter(F.size("qs") >= RUN).drop("run")
    runs = save(runs.unionByName(rows.withColumn("long", F.lit(True))), "runs")

    # values of aligned placeholders of one type, over the tokens that the windows span
    ids = broadcast_if_small(*_bounded(runs.select("doc_id", "th").distinct(), "ids", keep))
    texts = src.withColumn("th", F.xxhash64("text")).alias("d").join(ids.alias("i"), [F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), F.col("d.th") == F.col("i.th")], "left_semi")
    texts = texts.select(F.col("doc_id").alias("did"), F.col("th").alias("dth"), template_tokens(F.col("text")).alias("dt")).dropDuplicates(["did", "dth"])
    texts = texts.withColumn("dt", F.transform("dt", lambda t: _view(t, "S")))
    held = runs.join(texts, [F.col("doc_id").eqNullSafe(F.col("did")), F.col("th") == F.col("dth")]).join(classes.select("var", F.col("tokens").alias("ct")), "var")
    as_t, as_s, as_l = F.transform("ct", lambda t: _view(t, "T")), F.transform("ct", lambda t: _view(t, "S")), F.transform("ct", lambda t: _view(t, "L"))
    held = held.withColumn("ct", F.when(F.col("view").isin("T", "W"), as_t).when(F.col("view") == "S", as_s).otherwise(as_l))
    length = F.col("q1") - F.col("q0")
    pairs = F.filter(
        F.arrays_zip(F.slice("ct", F.col("q0") + 1, length).alias("c"), F.slice("dt", F.col("q0") + F.col("shift") + 1, length).alias("d")),
        lambda x: _is_slot(x["c"]) & (F.substring(x["c"], 1, 1) == F.substring(x["d"], 1, 1)),
    )
    held = held.withColumn("pairs", F.array_distinct(pairs))
    count = lambda f: F.size(F.array_distinct(F.transform("pairs", lambda x: x[f])))
    held = held.withColumns({
        "ok": (count("c") == F.size("pairs")) & (count("d") == F.size("pairs")),
        "other": F.exists("pairs", lambda x: x["c"] != x["d"]),
    })
    found = held.filter("ok").groupBy("doc_id", "th", "var", "view", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).cast("long").alias("matched"), F.max("other").alias("reparameterised"), F.max("long").alias("long")
    )
    found = found.filter(F.col("long") | (F.col("matched") >= COVER * F.col("n_windows")))
    found = found.join(classes.select("var", "cls"), "var").groupBy("doc_id", "cls").agg(
        F.max(F.struct(F.col("matched") / F.col("n_windows"), "matched", "n_windows")).alias("best"), F.max("reparameterised").alias("reparameterised")
    )
    return found.join(classes.filter("var = cls").select("cls", "n_items"), "cls").select(
        "doc_id", F.col("cls").alias("item_id"), "n_items", "best.matched", "best.n_windows", "reparameterised"
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns.

    Rows that share an id are judged together.  If a row without an id holds
    an item, rows are judged by a 128-bit hash of their text instead.
    """
    found = contaminated(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("bad_id")).distinct()
    found, n = save_counted(found, "found")
    if found.filter("bad_id IS NULL").isEmpty():
        own_id = free_name(docs, "bad_id")
        return docs.join(broadcast_if_small(found.toDF(own_id), MAX_BROADCAST, n), F.col(id_col).cast("long") == F.col(own_id), "left_anti")
    key = free_name(docs, "text_key")
    marked = docs.withColumn(key, F.struct(F.xxhash64(text_col).alias("x"), F.xxhash64(F.lit(1), F.col(text_col)).alias("y")))
    view = marked.select(F.col(key), F.col(text_col)).dropDuplicates([key])
    view = save(view.withColumn("n", F.monotonically_increasing_id()), "view")
    bad = contaminated(view, benchmark, "n", text_col).select(F.col("doc_id").alias("n")).distinct().join(view.select("n", key), "n").select(key)
    return marked.join(broadcast_if_small(bad, MAX_BROADCAST), key, "left_anti").drop(key)
