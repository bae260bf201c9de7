"""Personal data by candidate gradient boosting (DataFrame and SQL functions only).

1. Generators propose spans with high recall: the four base patterns, whose valid
   matches always stay, and looser or tighter ones whose spans may overlap them
   (a card number right behind a phone number, an obfuscated address, ...).
2. Format and context features of each candidate are small integers, computed
   in SQL.  The labelled candidates of all documents shrink to a count for each
   feature pattern, and boosted trees are fitted to those counts: a level of a
   tree needs the sums of gradients by feature and value only.
3. Platt scaling and, for each kind, the smallest threshold with the wanted
   precision on held-out documents decide which candidates are added.

The fitted trees become one SQL expression over the candidates of a row: scoring
needs no shuffle, no join and no function outside Spark SQL.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from faultlens.llm.common import pick, settle, whole_text

KINDS = ("email", "ip", "card", "phone")

# Leftmost non-overlapping matches of the contract's patterns. A match may begin only where its run of characters
# begins or the match before it ended (\G): elsewhere the same suffix has failed already. With possessive loops
# the search is linear in very long runs and doesn't recurse.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?:(?<![0-9]{2})|(?<=\G[0-9]))[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?<![0-9]{2})|(?<=\G[0-9]))(?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that a text without a match of the kind mostly fails.
_GUARD = {"email": "contains(text, '@')", "ip": "text rlike '[0-9][.][0-9]'", "card": "text rlike '[0-9]{2}|[0-9][ -][0-9]'",
          "phone": "text rlike '[+][0-9]'"}
_DOT = r"(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.)"
#: More proposals for the model to judge.
EXTRA = [
    ("phone", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])", "text rlike '[+][0-9]'"),
    ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "text rlike '[0-9]{3}[ .-][0-9]{4}'"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])", "text rlike '[0-9]{4}'"),
    ("card", r"(?<![0-9])[0-9]{16,19}(?![0-9])", "text rlike '[0-9]{16}'"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", "text rlike '[0-9][.][0-9]'"),
    # a dot in brackets may stand between blanks, a plain one may not, and the last part is a word: prose seldom looks like that
    ("email", rf"[A-Za-z0-9._%+-]{{1,64}} ?(?:\(at\)|\[at\]|\{{at\}}) ?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,7}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9-])",
     "text rlike '[(\\\\[{]at[)\\\\]}]'"),
]
#: Words that name the kind, in the four languages of the corpus.
CONTEXT = {"email": "mail|correo|courriel", "ip": r"\bip\b|host|server|addr", "card": "card|visa|karte|carte|tarjeta",
           "phone": "phone|tel|call|fon|llam"}
FEATURES = ("kind", "digits", "others", "luhn", "octets", "plus", "parens", "before", "after", "context", "longest", "groups",
            "blanks", "tail", "caps")
#: Prefix sums of match lengths go by blocks of this size.
_BLOCK = 256
#: The greatest value of a feature, and a bound above all of them.
_CAP, _VALUES = 24, 32
#: Gradients are whole multiples of 1 / _UNIT, so that they add up exactly in any order and place; leaf values are
#: multiples of 1 / _STEP and at most _MOST, so that candidates have a bounded number of different margins.
_UNIT, _STEP, _MOST = 1 << 20, 64, 8.0


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds ``value`` to ``name`` once (an expression inlined in a lambda would run for each element)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _found(pattern: str, guard: str) -> str:
    """SQL for ``array<struct<start, m>>``: all matches with their code-point offsets (the gaps come from split)."""
    b = _BLOCK
    starts = (
        f"transform(found, (m, i) -> struct(cast(front[i div {b}] "
        f"+ aggregate(slice(steps, (i div {b}) * {b} + 1, i % {b}), 0L, (a, x) -> a + x) + length(gaps[i]) as int) as start, m as m))")
    fronts = f"transform(sums, (s, k) -> aggregate(slice(sums, 1, k), 0L, (a, x) -> a + x))"
    sums = f"transform(sequence(0, (size(found) - 1) div {b}), k -> aggregate(slice(steps, k * {b} + 1, {b}), 0L, (a, x) -> a + x))"
    steps = "transform(found, (m, i) -> cast(length(m) + length(gaps[i]) as bigint))"
    body = _let(steps, "steps", _let(sums, "sums", _let(fronts, "front", starts)))
    body = _let(f"split(text, r'{pattern}', -1)", "gaps", body)
    empty = "cast(array() as array<struct<start: int, m: string>>)"
    return (f"case when {guard} then " + _let(f"regexp_extract_all(text, r'{pattern}', 0)", "found",
            f"case when size(found) = 0 then {empty} else {body} end") + f" else {empty} end")


# A part of zeros only ends with them: the possessive loop has eaten its last digit.
_OCTET = "0*+(?:(?<=0)(?![0-9])|25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_LUHN = ("aggregate(sequence(1, length(d)), 0, (a, i) -> a + case when (length(d) - i) % 2 = 1 "
         "then int((2 * int(substr(d, i, 1))) div 10) + (2 * int(substr(d, i, 1))) % 10 else int(substr(d, i, 1)) end) % 10 = 0")


def _features(kind: int) -> str:
    """SQL struct of a match ``x`` (start, m): span, validity under the base rule, and the features."""
    side = ("case when {c} = '' or {c} rlike '[ \\\\t\\\\r\\\\n]' then 0 when {c} rlike '[0-9]' then 2 "
            "when {c} rlike '\\\\p{{L}}' then 1 when {c} in ('=', ':', '\"', '#') then 3 else 4 end")
    valid = {"email": "true", "ip": f"x.m rlike '^{_OCTET}([.]{_OCTET}){{3}}$'", "card": "length(d) between 16 and 19 and luhn",
             "phone": "length(d) between 8 and 15"}[KINDS[kind]]
    fields = ", ".join([
        "x.start as start", "x.start + length(x.m) as end", f"coalesce({valid}, false) as valid",
        f"{kind} as kind", f"least(length(d), {_CAP}) as digits", f"least(length(x.m) - length(d), {_CAP}) as others",
        "int(luhn) as luhn", f"int(x.m rlike '^{_OCTET}([.]{_OCTET}){{3}}$') as octets",
        "int(startswith(x.m, '+')) as plus", "least(length(x.m) - length(translate(x.m, '()[]{}', '')), 9) as parens",
        side.format(c="prev") + " as before", side.format(c="next") + " as after",
        f"int(ctx rlike '{CONTEXT[KINDS[kind]]}') as context".replace("\\b", "\\\\b"),
        f"least(array_max(transform(parts, p -> length(p))), {_CAP}) as longest", f"least(size(parts), {_CAP}) as groups",
        f"least(length(x.m) - length(translate(x.m, ' ', '')), {_CAP}) as blanks",
        f"least(length(regexp_extract(x.m, '[A-Za-z]*$', 0)), {_CAP}) as tail", "int(x.m rlike '[A-Z][a-z]*$') as caps"])
    body = f"struct({fields})"
    body = _let("case when length(d) between 12 and 19 then " + _LUHN + " else false end", "luhn", body)
    body = _let("split(x.m, '[^0-9]+')", "parts", body)
    body = _let("lower(substring(text, greatest(x.start - 23, 1), least(x.start, 24)))", "ctx", body)
    body = _let("substring(text, x.start + length(x.m) + 1, 1)", "next", body)
    body = _let("case when x.start = 0 then '' else substring(text, x.start, 1) end", "prev", body)
    return _let("regexp_replace(x.m, '[^0-9]+', '')", "d", body)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: bool = True) -> DataFrame:
    """``(id, base, extra)``: arrays of candidate structs of every row; ``base`` keeps failing matches, marked not valid.

    Without ``more`` there is no ``extra``.
    """
    text = pick(docs, id_col, text_col).select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))

    def spans(kind: str, pattern: str, guard: str) -> str:
        return f"transform({_found(pattern, guard)}, x -> {_features(KINDS.index(kind))})"

    base = ", ".join(spans(k, BASE[k], _GUARD[k]) for k in KINDS)
    extra = ", ".join(spans(*e) for e in EXTRA)
    found = [F.expr(f"concat({base})").alias("base"), F.expr(f"concat({extra})").alias("extra")]
    return settle(text.select("id", *found[:2 if more else 1]))


@dataclass
class Node:
    """A regression tree's node: a leaf has no feature. While a tree grows, ``place`` numbers the leaves to be split."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: Node | None = None
    high: Node | None = None
    place: int = -1

    def sql(self, c: str, of: Callable[[Node], str] = lambda leaf: f"{leaf.value:.6f}D") -> str:
        if self.feature < 0:
            return of(self)
        return f"(case when {c}.{FEATURES[self.feature]} <= {self.cut} then {self.low.sql(c, of)} else {self.high.sql(c, of)} end)"

    def apply(self, x: np.ndarray, of: Callable[[Node], float] = lambda leaf: leaf.value) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), of(self))
        return np.where(x[:, self.feature] <= self.cut, self.low.apply(x, of), self.high.apply(x, of))


@dataclass
class Detector:
    """Boosted trees with Platt scaling (``scale``, ``shift``) and a probability threshold for each kind."""

    trees: list[Node] = field(default_factory=list)
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score_sql(self, c: str) -> str:
        total = " + ".join(t.sql(c) for t in self.trees) or "0D"
        return f"(1D / (1D + exp(-({self.scale:.6f}D * ({total}) + ({self.shift:.6f}D)))))"

    def threshold_sql(self, c: str) -> str:
        return f"element_at(array({', '.join(f'{self.thresholds.get(k, 2.0):.6f}D' for k in KINDS)}), {c}.kind + 1)"


#: Of the trees so far and one that grows: gradient and second derivative, ``(2, places, features, values)``.
Sums = Callable[[list[Node], Node, int], np.ndarray]


def _leaf(g: float, h: float, rate: float, penalty: float) -> float:
    """The Newton step of a leaf, a multiple of 1 / _STEP."""
    return float(np.clip(np.rint(-rate * g / (h + penalty) * _STEP) / _STEP, -_MOST, _MOST))


def _grow(sums: Callable[[Node, int], np.ndarray], depth: int, rate: float, penalty: float = 1.0) -> Node:
    """Newton tree on weighted gradients, level by level; ties take the first feature and cut."""
    root = Node()
    level = [root]
    for _ in range(depth):
        for k, node in enumerate(level):
            node.place = k
        below = []
        for node, g, h in zip(level, *sums(root, len(level))):
            node.place = -1
            g_all, h_all = g[0].sum(), h[0].sum()
            if node is root:
                root.value = _leaf(g_all, h_all, rate, penalty)
            gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
            gr, hr = g_all - gl, h_all - hl
            gain = gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - g_all * g_all / (h_all + penalty)
            f, cut = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[f, cut] > 1e-6:
                node.feature, node.cut = int(f), int(cut)
                node.low = Node(_leaf(gl[f, cut], hl[f, cut], rate, penalty))
                node.high = Node(_leaf(gr[f, cut], hr[f, cut], rate, penalty))
                below += [node.low, node.high]
        level = below
        if not level:
            break
    return root


def _boosted(sums: Sums, rounds: int = 25, depth: int = 4, rate: float = 0.4) -> list[Node]:
    trees: list[Node] = []
    for _ in range(rounds):
        trees.append(_grow(lambda root, places: sums(trees, root, places), depth, rate))
    return trees


def _sums_here(x: np.ndarray, pos: np.ndarray, n: np.ndarray) -> Sums:
    """The sums over patterns in memory."""
    held = [0, np.zeros(len(x))]
    features = x.shape[1]

    def sums(trees: list[Node], root: Node, places: int) -> np.ndarray:
        for t in trees[held[0]:]:
            held[1] = held[1] + t.apply(x)
        held[0] = len(trees)
        p = 1 / (1 + np.exp(-held[1]))
        place = root.apply(x, lambda leaf: leaf.place).astype(np.int64)
        some = place >= 0
        cell = (place[some, None] * features + np.arange(features)) * _VALUES + x[some]
        both = [np.bincount(cell.ravel(), np.repeat(np.floor(v[some] * _UNIT + 0.5), features), places * features * _VALUES)
                for v in (n * p - pos, n * p * (1 - p))]
        return np.stack(both).reshape(2, places, features, _VALUES) / _UNIT
    return sums


def _sums_spread(patterns: DataFrame, weight: float) -> Sums:
    """The sums over patterns of a table: a row for each place, feature and value comes to the driver."""
    count = f"case when own then {weight!r}D else 1D end * "
    held = [0, settle(patterns.select(*FEATURES, F.expr(count + "pos").alias("pos"), F.expr(count + "n").alias("n"),
                                      F.lit(0.0).alias("margin")))]

    def sums(trees: list[Node], root: Node, places: int) -> np.ndarray:
        if held[0] < len(trees):
            new = " + ".join(t.sql("t") for t in trees[held[0]:])
            held[1] = settle(held[1].alias("t").select(*FEATURES, "pos", "n", F.expr(f"margin + {new}").alias("margin")))
            held[0] = len(trees)
        rows = held[1].alias("t").select(F.expr(root.sql("t", lambda leaf: str(leaf.place))).alias("place"), "pos", "n",
                                         F.expr("1D / (1D + exp(-margin))").alias("p"), F.array(*FEATURES).alias("x"))
        rows = rows.where("place >= 0").select(
            "place", F.expr(f"cast(floor((n * p - pos) * {_UNIT} + 0.5D) as bigint)").alias("g"),
            F.expr(f"cast(floor(n * p * (1D - p) * {_UNIT} + 0.5D) as bigint)").alias("h"), F.posexplode("x").alias("f", "v"))
        out = np.zeros((2, places, len(FEATURES), _VALUES))
        for r in rows.groupBy("place", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r["place"], r["f"], r["v"]] = r["g"], r["h"]
        return out / _UNIT
    return sums


def boost(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = 25, depth: int = 4, rate: float = 0.4) -> list[Node]:
    """Logistic boosting on feature patterns with counts of positive and negative candidates."""
    return _boosted(_sums_here(x, pos, pos + neg), rounds if len(x) else 0, depth, rate)


def platt(margin: np.ndarray, pos: np.ndarray, neg: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Scale and shift of the calibrated log-odds, with Platt's smoothed targets (Newton steps)."""
    n1, n0 = pos.sum(), neg.sum()
    if not n1 or not n0:
        return 1.0, 0.0
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        r = (pos + neg) * p - pos * hi - neg * lo
        w = (pos + neg) * p * (1 - p)
        hess = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, np.array([(r * margin).sum(), r.sum()]))
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    return float(a), float(b)


def examples(n: int = 60, seed: int = 11) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Made-up lines with the spans of personal data in them: every kind in several forms, and look-alikes that are none.

    The labels come from how a line is made, not from the features: prose with a bracketed "at", prices, times, versions,
    part numbers and numbers that fail a check have none.
    """
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abdeilmnorstu") for _ in range(rnd.randint(3, 8)))

    def card(good: bool) -> str:
        body = rnd.choice("3456") + digits(14)
        odd = sum((2 * int(c)) // 10 + (2 * int(c)) % 10 if i % 2 == 0 else int(c) for i, c in enumerate(body))
        check = (10 - odd % 10) % 10
        return body + str(check if good else (check + rnd.randint(1, 9)) % 10)

    lines = []

    def line(before: str, kind: str | None, text: str, after: str) -> None:
        lines.append((f"{before}{text}{after}", {(kind, len(before), len(before) + len(text))} if kind else set()))

    for _ in range(n):
        ip = [str(rnd.randint(0, 255)) for _ in range(4)]
        bad = [*ip[:2], str(rnd.randint(256, 999)), ip[3]]
        good = card(True)
        line("aba ", "card", good, " ano")
        line("aba ", "card", " ".join(good[k:k + 4] for k in range(0, 16, 4)), " ano")
        line("aba ", None, card(False), " ano")
        line("re ", "ip", ".".join(ip), " to")
        line("re ", None, ".".join(bad), " to")
        area = f"({digits(3)}) {digits(3)}-{digits(4)}"
        line("on ", "phone", f"+{rnd.randint(1, 99)} {area}", " en")
        line("on ", "phone", f"+{digits(10)}", " en")
        line("call ", "phone", area, " now")
        line("part ", None, f"{digits(3)}.{digits(3)}.{digits(4)}", " of")
        line("on ", None, f"+{digits(3)}", " en")
        line("on ", None, f"+1 {digits(20)}", " en")
        line("at ", None, f"{digits(3)} to {digits(5)} in {digits(2)}-{digits(2)}-{digits(4)}", " or")
        tld = rnd.choice(("com", "org", "net", "de", "fr", "es"))
        line("la ", "email", f"{rnd.choice('abcdef')}{digits(2)}@mail{digits(1)}.example.{tld}", " de")
        at, dot = rnd.choice((("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}")))
        line("la ", "email", f"{word()}{at}{word()}.{tld}", " de")
        line("mail ", "email", f"{word()}.{word()} {at} {word()} {dot} {tld}", ", de")
        line("la ", "email", f"{word()} {at} {word()}{dot}{tld}", "")
        # prose: a sentence that ends behind the place, with and without the blank
        line(f"{word()} ", None, f"{word()} {at} {word()}.{word().capitalize()}", f" {word()}")
        line(f"{word()} ", None, f"{word()} {at} {word()}. {word().capitalize()}", f" {word()}")
        line("price ", None, f"{at} {rnd.randint(1, 99)}.{digits(2)}", " each")
        line("price ", None, f"{word()} {at} {rnd.randint(1, 99)}.{word().capitalize()}", " more")
        line("from ", None, f"{rnd.randint(0, 23)}:{digits(2)} {at} {word()}", f" v{rnd.randint(1, 9)}.{rnd.randint(0, 20)}")
    return lines


def _made(spark, lines: list[tuple[str, set]]) -> list[tuple[bool, bool, list[int]]]:
    """``(label, only calibrates, features)`` of every candidate of the made-up lines (a fixed number of them)."""
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(lines)], "id int, text string")
    found = candidates(rows, "id", "text").select("id", F.explode(F.concat("base", "extra")).alias("c")).select("id", "c.*").collect()
    return [((KINDS[r["kind"]], r["start"], r["end"]) in lines[r["id"]][1], r["id"] % 4 == 0, [r[f] for f in FEATURES]) for r in found]


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``(own, aside, features..., pos, n)`` and the number of rows of ``docs``.

    Counts of each feature pattern over the base candidates of all rows (``own``) and all candidates of the made-up lines.
    """
    own = pick(docs, id_col, text_col).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = candidates(own, "id", "text", more=False)
    rows = found.select("id", F.explode("base").alias("c")).select(
        F.lit(True).alias("own"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("aside"), F.col("c.valid").alias("y"),
        *[F.col(f"c.{f}").cast("int").alias(f) for f in FEATURES])
    made = [(False, bool(a), bool(y), *map(int, x)) for y, a, x in _made(docs.sparkSession, examples())]
    made = docs.sparkSession.createDataFrame(made, "own boolean, aside boolean, y boolean, " + ", ".join(f"{f} int" for f in FEATURES))
    counted = rows.unionByName(made).groupBy("own", "aside", *FEATURES).agg(F.sum(F.col("y").cast("long")).alias("pos"), F.count("*").alias("n"))
    return settle(counted), found.count()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", worth: int = 20_000, at_driver: int = 50_000,
          precision: float = 0.99) -> Detector:
    """Fit a detector on the candidates of all documents and of :func:`examples`.

    A candidate of a base pattern in a document is positive if it passes that pattern's check; a candidate in a made-up
    line if it is one of that line's spans. Every candidate of every document is counted; beyond ``worth`` documents the
    counts are scaled to the weight of so many, so that the made-up lines weigh the same in any corpus. Of at most
    ``at_driver`` feature patterns the driver holds the counts; of more, Spark adds up the gradients, to the same trees.
    A quarter of the documents and lines only calibrates. Null and empty texts have no candidates; repeated rows count
    each; an empty table leaves the made-up lines.
    """
    found, rows = patterns(docs, id_col, text_col)
    weight = min(1.0, worth / max(1, rows))
    fitted = found.where("not aside")
    if fitted.count() <= at_driver:
        fitted = fitted.collect()
        x = np.array([[r[f] for f in FEATURES] for r in fitted], np.int64).reshape(-1, len(FEATURES))
        pos, n = (np.array([(weight if r["own"] else 1.0) * r[c] for r in fitted]) for c in ("pos", "n"))
        sums = _sums_here(x, pos, n)
    else:
        sums = _sums_spread(fitted, weight)
    trees = _boosted(sums)
    # candidates that only calibrate, by kind and margin: leaf values are few, so are these
    margin = " + ".join(t.sql("t") for t in trees)
    rest = (found.where("aside").alias("t").select("own", "kind", "pos", "n", F.expr(margin).alias("margin"))
            .groupBy("own", "kind", "margin").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
            .orderBy("kind", "margin", "own").collect())
    margin = np.array([r["margin"] for r in rest], float)
    pos, n = (np.array([(weight if r["own"] else 1.0) * r[c] for r in rest], float) for c in ("pos", "n"))
    detector = Detector(trees, *platt(margin, pos, n - pos))
    score = 1 / (1 + np.exp(-(detector.scale * margin + detector.shift)))
    for k, kind in enumerate(KINDS):
        mine = np.array([r["kind"] == k for r in rest], bool)
        s, at = np.unique(score[mine], return_inverse=True)
        good, every = (np.bincount(at, v[mine], len(s)) for v in (pos, n))
        # all candidates of at least each score
        above = [v[::-1].cumsum()[::-1] for v in (good, every)]
        fits = np.flatnonzero((good > 0) & (s >= 0.5) & (above[0] >= precision * above[1]))
        if len(fits):
            cut = s[fits[0]]
            # half-way down to the next score below, so that equal patterns pass on any platform
            detector.thresholds[kind] = float((cut + max(0.5, s[fits[0] - 1])) / 2 if fits[0] else max(0.5, cut * 0.99))
    return detector


def spans(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, added)``: sorted arrays of ``struct<kind, start, end>`` of every row.

    An added span scores at least its kind's threshold and overlaps no base span; of overlapping ones the
    highest score stays, then the earliest.
    """
    found = candidates(docs, id_col, text_col)
    plain = "struct({c}.kind as kind, {c}.start as start, {c}.end as end)"
    base = f"array_sort(transform(filter(base, c -> c.valid), c -> {plain.format(c='c')}))"
    found = found.select("id", F.expr(base).alias("base"), F.expr(
        f"transform(extra, c -> struct({detector.score_sql('c')} as score, {detector.threshold_sql('c')} as least, "
        "c.start as start, c.end as end, c.kind as kind))").alias("scored"))
    free = ("filter(scored, c -> c.score >= c.least and not exists(base, b -> c.start < b.end and b.start < c.end))")
    order = ("array_sort({a}, (l, r) -> case when l.score > r.score then -1 when l.score < r.score then 1 "
             "when l.start < r.start then -1 when l.start > r.start then 1 when l.end > r.end then -1 when l.end < r.end then 1 "
             "else l.kind - r.kind end)")
    found = found.select("id", "base", F.expr(order.format(a=free)).alias("free"))
    kept = ("aggregate(free, cast(array() as array<struct<kind: int, start: int, end: int>>), (kept, c) -> "
            "case when exists(kept, k -> c.start < k.end and k.start < c.end) then kept "
            f"else concat(kept, array({plain.format(c='c')})) end)")
    return found.select("id", "base", F.expr(f"case when size(free) = 0 then "
                        f"cast(array() as array<struct<kind: int, start: int, end: int>>) else array_sort({kept}) end").alias("added"))


def _listed(spans_col: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans_col}, s -> concat_ws(':', element_at(array({names}), s.kind + 1), s.start, s.end)), ',')")


def report(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: base counts of each kind, ``base_sha256`` and ``spans`` (base and added).

    Null and empty texts have no spans (the digest is that of the empty string). Repeated rows and null ids give a
    row each; an empty table gives none; extra columns are ignored. Offsets are code points, ends exclusive.
    """
    found = spans(docs, detector, id_col, text_col)
    counts = [F.expr(f"cast(size(filter(base, b -> b.kind = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        F.col("id").alias(id_col), *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"),
        _listed("array_sort(concat(base, added))").alias("spans"))


def redact(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in brackets; overlapping spans become one.

    Texts are matched to their spans by id and text hash, so rows that share an id keep their own spans.
    """
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).alias("i"), F.sha2(whole_text(text_col).cast("binary"), 256).alias("h")))
    found = spans(keyed.select("__key", F.col(text_col)), detector, "__key", text_col)
    found = found.select("id", F.expr("array_sort(transform(concat(base, added), s -> struct(s.start as start, s.end as end, s.kind as kind)))")
                         .alias("spans")).where("size(spans) > 0")
    merged = ("aggregate(spans, cast(array() as array<struct<start: int, end: int, kind: int>>), (kept, s) -> case "
              "when size(kept) > 0 and s.start < element_at(kept, -1).end then concat(slice(kept, 1, size(kept) - 1), array(struct("
              "element_at(kept, -1).start as start, greatest(s.end, element_at(kept, -1).end) as end, element_at(kept, -1).kind as kind))) "
              "else concat(kept, array(s)) end)")
    found = found.select(F.col("id.i").alias("__i"), F.col("id.h").alias("__h"), F.expr(merged).alias("__spans")).dropDuplicates(["__i", "__h"])
    marked = keyed.select("*", F.col("__key.i").alias("__ki"), F.col("__key.h").alias("__kh"))
    joined = marked.join(found, F.col("__ki").eqNullSafe(F.col("__i")) & (F.col("__kh") == F.col("__h")), "left")
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    t = f"`{text_col}`"
    pieces = (f"array_join(concat(transform(__spans, (s, i) -> concat(substring({t}, case when i = 0 then 1 else __spans[i - 1].end + 1 end, "
              "s.start - case when i = 0 then 0 else __spans[i - 1].end end), "
              f"element_at(array({names}), s.kind + 1))), array(substring({t}, element_at(__spans, -1).end + 1))), '')")
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(F.expr(pieces))
    return joined.withColumn(text_col, clean).select(*docs.columns)
