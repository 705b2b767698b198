"""PII: candidate spans scored by boosted trees, in DataFrame functions only.

Fixed patterns give the base spans.  Wider generators propose further, possibly overlapping spans:
digit groups, address-like words with an obfuscated ``@``, dotted numbers.  Every candidate gets format
features (digits, separators, length, check digit) and context features (the characters and key words
beside it), all of them small whole numbers.  Candidates are counted per distinct feature vector over
the whole corpus; gradient boosting of depth-two trees runs on these counted cells, of which there is
a fixed number at most, and the trees become one SQL expression.  A threshold per kind, calibrated
on the same counts, selects what is redacted; base spans always are.

The labels of the cells are weak: a base match that passes its checks is personal data, one that
fails them is not.  The features do not repeat those checks.  For the generators, base matches that
pass also stand in masked forms, phones without their ``+`` and e-mails without their ``@``; pieces of
longer tokens, failed dotted quads and failed card numbers are no personal data.  All else that they
propose has no label.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from eddymap.llm.common import cut

LOCAL, DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# The base kinds in order with their patterns.  Quantifiers are possessive, and an e-mail
# or address may begin only where a run of its characters does (or at the end of the last match), which
# finds the same leftmost matches in time linear in the text.
BASE = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{DOMAIN}]++(?:\.[{DOMAIN}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATED = {
    # One grouped number, or else any digits with at most three marks between two of them; ends on a digit.
    "number": r"(?<![0-9+])(?:(?:[0-9]{1,2}[\x20.-])?\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
              r"|[0-9(](?:[\x20().-]{0,3}+[0-9]){5,19}(?![0-9]))",
    "contact": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?(?:\(at\)|\[at\]|at)\x20?[{DOMAIN}]++(?:\x20?(?:\(dot\)|\[dot\]|dot)\x20?[{DOMAIN}]++)++",
}
KINDS = (*BASE, *GENERATED)
#: A text without this cannot hold a match.
NEEDED = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){6}", "phone": "[+][0-9]",
          "number": r"[0-9(][0-9\x20().-]{6}", "contact": r"(?:[(\[]dot|\x20dot\x20)"}
CUES = "(?i)(?:call|tel|phone|fax|mobile|mail|contact|card|visa|account|address|host|from)"
#: Digits grouped as in phone numbers; obfuscated addresses by their brackets or a common last name.
GROUPED = r"^(?:[0-9]{1,3}[\x20.-])?\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3,4}[\x20.-][0-9]{3,4}$"
BRACKETED, COMMON_END = r"[(\[](?:at|dot)[)\]]", r"(?i)(?:com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|eu)$"
LONGEST_NUMBER = 21
#: Least length of a part of a long text, and how many characters before a candidate are looked at.
PART, BEFORE = 4096, 24
# A part ends before a character that no pattern holds, or before a blank that none can have there.
_HELD = rf"{LOCAL}@\x20()\[\]"
_FREE_BLANK = r"(?<!at)(?<!dot)(?<![)\]])\x20(?:\+|(?!at|dot)[A-Za-z])"
LEVELS = {"kind": 6, "digits": 6, "marks": 4, "variety": 3, "left": 4, "right": 4, "cue": 2, "shape": 3}
_CANDIDATE = "array<struct<kind: int, start: int, stop: int, passed: boolean, " + ", ".join(
    f"{f}: int" for f in list(LEVELS)[1:]) + ">>"


def _luhn(digits: Column) -> Column:
    backward = F.reverse(digits)
    worth = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: (
        F.substring(backward, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def _bucket(value: Column, *bounds: int) -> Column:
    """How many bounds the value reaches."""
    total = F.lit(0)
    for b in bounds:
        total = total + (value >= b).cast("int")
    return total


def _beside(char: Column) -> Column:
    """0 blank or nothing, 1 punctuation, 2 letter, 3 digit."""
    return (F.when((char == "") | char.rlike(r"^\s"), 0).when(char.rlike("^[0-9]"), 3)
            .when(char.rlike(r"^[\p{L}_]"), 2).otherwise(1))


def _shape(kind: str, hit: Column) -> Column:
    """0 nothing known, 1 grouped digits or an address in words with a common end, 2 an address with brackets."""
    if kind == "contact":
        return F.when(hit.rlike(BRACKETED), 2).when(hit.rlike(COMMON_END), 1).otherwise(0)
    return F.when(hit.rlike(GROUPED), 1).otherwise(0)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parts(text: Column, size: int = PART) -> Column:
    """The text in parts: an array of ``at``, ``lead`` (what stands before), ``body`` and ``follow`` (the next character).

    Joined in order the bodies are the text, and every match in the text is a match in one body.
    """
    long_parts = F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}(?:(?!{_FREE_BLANK})[{_HELD}])*+|(?s).+"), F.lit(0))
    bodies = F.when(F.length(text) > size, long_parts).otherwise(F.array(text))
    ends = lambda b: F.aggregate(b, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x))))

    def laid(x: Column) -> Column:
        return F.transform(x["bodies"], lambda body, i: F.struct(
            F.get(x["ends"], i).alias("at"),
            F.coalesce(F.right(F.get(x["bodies"], i - 1), F.lit(BEFORE)), F.lit("")).alias("lead"),
            body.alias("body"),
            F.coalesce(F.substring(F.get(x["bodies"], i + 1), 1, 1), F.lit("")).alias("follow")))

    return _let(bodies, lambda b: _let(F.struct(b.alias("bodies"), ends(b).alias("ends")), laid))


def _found(part: Column, kind: str) -> Column:
    """Candidates of one kind in a part of a text, in order, with their features; positions are the text's.

    ``split`` gives what lies between the matches, so lengths add up to positions in code points.
    """
    pattern, body = BASE.get(kind) or GENERATED[kind], part["body"]
    pieces = F.zip_with(F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)),
                        lambda before, hit: F.struct(before.alias("before"), hit.alias("hit")))

    def described(start: Column, stop: Column, hit: Column, kind: str = kind, shape: int | None = None) -> Column:
        digits = F.regexp_replace(hit, "[^0-9]", "")
        near = F.substring(body, F.greatest(start - (BEFORE - 1), F.lit(1)), F.least(start, F.lit(BEFORE)))
        before = F.right(F.concat(part["lead"], near), F.lit(BEFORE))
        left = F.when(start > 0, F.substring(body, start, F.lit(1))).otherwise("")
        right = F.when(stop < F.length(body), F.substring(body, stop + 1, F.lit(1))).otherwise(part["follow"])
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            (part["at"] + start).cast("int").alias("start"), (part["at"] + stop).cast("int").alias("stop"),
            (_passes(kind, hit) if kind in BASE else F.lit(False)).alias("passed"),
            _bucket(F.length(digits), 7, 9, 12, 16, 20).alias("digits"),
            _bucket(F.length(hit) - F.length(digits), 1, 2, 4).alias("marks"),
            _bucket(F.size(F.array_distinct(F.split(digits, ""))), 3, 7).alias("variety"),
            _beside(left).alias("left"), _beside(right).alias("right"),
            before.rlike(CUES).cast("int").alias("cue"), (_shape(kind, hit) if shape is None else F.lit(shape)).alias("shape"))

    def forms(start: Column, hit: Column) -> Column:
        """The candidate, and masked forms of a base span that passes; these overlap it, so they are never selected."""
        stop = start + F.length(hit)
        own = described(start, stop, hit)
        if kind == "phone":
            home = F.regexp_replace(hit, r"^\+(?:[0-9]{1,3}[\x20.-]+(?=[0-9(]))?", "")
            dashed = F.regexp_replace(F.regexp_replace(home, r"\(", ""), r"[)\x20.-]+", "-")
            masked = [described(start, stop, x, "number") for x in (F.regexp_replace(hit, r"^\+", ""), home, dashed)]
        elif kind == "email":
            masked = [described(start, stop, hit, "contact", 2), described(start, stop, hit, "contact")]
        else:
            return F.array(own)
        return F.when(own["passed"], F.array(own, *masked)).otherwise(F.array(own))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        plausible = F.length(x["hit"]) >= 7 if kind != "email" else F.lit(True)
        if kind == "number":
            plausible = F.length(x["hit"]).between(7, LONGEST_NUMBER)
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(
            (start + F.length(x["hit"])).alias("at"),
            F.when(plausible, F.concat(state["spans"], forms(start, x["hit"]))).otherwise(state["spans"]).alias("spans")))

    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(_CANDIDATE).alias("spans")), step)["spans"]


def candidate_parts(text: Column, size: int = PART) -> Column:
    """All candidates of a text, an array for each of its parts; candidates of different parts never overlap.

    A candidate has kind, start, stop, whether base checks pass, and features.  Masked forms of base
    spans are among them, for ``fit``.
    """
    def of_part(part: Column, needed: Column) -> Column:
        return F.concat(*[F.when(needed[kind], _found(part, kind)).otherwise(F.array().cast(_CANDIDATE)) for kind in KINDS])

    needed = F.struct(*[text.rlike(NEEDED[kind]).alias(kind) for kind in KINDS])
    return _let(needed, lambda n: F.transform(_parts(text, size), lambda part: of_part(part, n)))


def candidates(text: Column, size: int = PART) -> Column:
    """All candidates of a text in one array (see ``candidate_parts``)."""
    return F.flatten(candidate_parts(text, size))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def _tree(cells: list[tuple], grads: list[float], hesses: list[float]) -> tuple:
    """The depth-two regression tree of largest gain on ``cells``: ``(feature, bound, left, right)``."""
    names = list(LEVELS)

    def value(rows):
        return sum(grads[i] for i in rows) / (sum(hesses[i] for i in rows) + 1.0)

    def gain(rows):
        return sum(grads[i] for i in rows) ** 2 / (sum(hesses[i] for i in rows) + 1.0)

    def best(rows, depth):
        if depth == 0 or len(rows) < 2:
            return 0.3 * value(rows)
        found = (1e-6, None)
        for f, name in enumerate(names[:len(cells[0])]):
            sums = [[0.0, 0.0] for _ in range(LEVELS[name])]
            for i in rows:
                sums[cells[i][f]][0] += grads[i]
                sums[cells[i][f]][1] += hesses[i]
            g, h = sum(s[0] for s in sums), sum(s[1] for s in sums)
            left_g = left_h = 0.0
            for bound in range(1, LEVELS[name]):
                left_g, left_h = left_g + sums[bound - 1][0], left_h + sums[bound - 1][1]
                more = left_g ** 2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g ** 2 / (h + 1)
                found = max(found, (more, (f, bound)), key=lambda x: x[0])
        if found[1] is None:
            return 0.3 * value(rows)
        f, bound = found[1]
        low, high = [i for i in rows if cells[i][f] < bound], [i for i in rows if cells[i][f] >= bound]
        return f, bound, best(low, depth - 1), best(high, depth - 1)

    return best(list(range(len(cells))), 2)


def _apply(tree, cell) -> float:
    while isinstance(tree, tuple):
        f, bound, low, high = tree
        tree = low if cell[f] < bound else high
    return tree


def boost(cells: list[tuple], good: list[int], bad: list[int], rounds: int = 40) -> list:
    """Trees fitted by Newton steps on the logistic loss of weighted cells."""
    trees, scores = [], [0.0] * len(cells)
    for _ in range(rounds if cells else 0):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        grads = [g * (1 - p) - b * p for p, g, b in zip(chance, good, bad)]
        hesses = [(g + b) * p * (1 - p) for p, g, b in zip(chance, good, bad)]
        tree = _tree(cells, grads, hesses)
        trees.append(tree)
        scores = [s + _apply(tree, c) for s, c in zip(scores, cells)]
    return trees


def _as_column(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, bound, low, high = tree
    return F.when(c[list(LEVELS)[f]] < bound, _as_column(low, c)).otherwise(_as_column(high, c))


class Redactor:
    """Trees, and per kind the score from which a candidate is taken."""

    def __init__(self, trees: list, floors: dict[int, float]):
        self.trees, self.floors = trees, floors

    def selected(self, found: Column) -> Column:
        """Of an array of candidates: the base spans, and the others that score high and touch none of them."""
        base = F.filter(found, lambda c: c["passed"])

        def takes(c: Column) -> Column:
            score = F.lit(0.0)
            for tree in self.trees:
                score = score + _as_column(tree, c)
            floor = F.lit(math.inf)
            for kind, least in self.floors.items():
                floor = F.when(c["kind"] == kind, F.lit(least)).otherwise(floor)
            return c["passed"] | ((score >= floor) & ~F.exists(base, lambda b: _overlaps(b, c)))

        return F.filter(found, takes)


def fit(candidate_rows: DataFrame, precision: float = 0.9) -> Redactor:
    """Boost on all candidates of a table with a column ``found`` (see ``candidate_parts``, or ``candidates``).

    The driver receives one row per distinct feature vector: at most the product of ``LEVELS``, 41,472.
    The floor of a kind is the lowest score above which at least ``precision`` of the labelled candidates
    are good; a kind without labels takes the floor of all.  As masked forms are counted but never added,
    a generated candidate must also be good by itself with a chance of ``precision``.
    """
    kind = {k: i for i, k in enumerate(KINDS)}

    def weak(found: Column) -> Column:
        base = F.filter(found, lambda c: c["kind"] < len(BASE))

        def label(c: Column) -> Column:
            near = F.filter(base, lambda b: _overlaps(b, c))
            masks = F.when(c["kind"] == kind["number"], kind["phone"]).otherwise(kind["email"])
            # A card match of another length than a card's says nothing about the number it is.
            refuted = F.exists(near, lambda b: ~b["passed"] & (
                (b["kind"] == kind["ip"]) | ((b["kind"] == kind["card"]) & b["digits"].between(3, 4))))
            odd = (c["left"] >= 2) | (c["right"] >= 2) | ((c["kind"] == kind["contact"]) & (c["shape"] == 0))
            return F.when(F.exists(near, lambda b: b["passed"] & (b["kind"] == masks)), True).when(refuted | odd, False)

        return F.transform(found, lambda c: F.struct(c.alias("c"), F.when(
            c["kind"] < len(BASE), c["passed"]).otherwise(label(c)).alias("label")))

    in_parts = isinstance(candidate_rows.schema["found"].dataType.elementType, ArrayType)
    parts = F.col("found") if in_parts else F.array("found")
    counted = (
        candidate_rows.select(F.explode(parts).alias("found")).filter(F.size("found") > 0)
        .select(F.explode(weak(F.col("found"))).alias("x"))
        .filter("x.label IS NOT NULL")
        .groupBy(*[F.col(f"x.c.{f}").alias(f) for f in LEVELS])
        .agg(F.sum(F.col("x.label").cast("int")).alias("good"), F.count(F.lit(1)).alias("all"))
        .collect()
    )
    rows = sorted((tuple(r[f] for f in LEVELS), r["good"], r["all"] - r["good"]) for r in counted)
    cells = [r[0] for r in rows]
    trees = boost(cells, [r[1] for r in rows], [r[2] for r in rows])
    scored = sorted(((sum(_apply(t, c) for t in trees), c[0], g, b) for c, g, b in rows), reverse=True)

    def floor(kind: int | None) -> float:
        least, good, bad = math.inf, 0, 0
        for i, (score, of, g, b) in enumerate(scored):
            if kind is None or of == kind:
                good, bad = good + g, bad + b
                last_of_score = i + 1 == len(scored) or scored[i + 1][0] < score
                if last_of_score and good >= precision * (good + bad):
                    least = score
        return least

    labelled = {c[0] for c in cells}
    floors = {k: floor(k if k in labelled else None) for k in range(len(KINDS))}
    sure = math.log(precision / (1 - precision)) if precision < 1 else math.inf
    return Redactor(trees, {k: max(least, sure) if k >= len(BASE) else least for k, least in floors.items()})


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    Null and empty texts have no spans; rows may repeat; an empty table gives no rows; other columns
    are ignored; spans with equal starts are ordered by kind.
    """
    # The text is a column of its own before the expressions that look at it many times.
    scanned = cut(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                  .select("doc_id", candidate_parts(F.col("text")).alias("found")), "pii-candidates")
    redactor = fit(scanned)
    names = F.array(*map(F.lit, KINDS))

    def told(spans: Column) -> Column:
        ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["start"], c["kind"], c["stop"])))
        return F.array_join(F.transform(ordered, lambda c: F.concat_ws(
            ":", F.element_at(names, c["kind"] + 1), c["start"].cast("string"), c["stop"].cast("string"))), ",")

    base = F.filter(F.flatten("found"), lambda c: c["passed"])
    return scanned.select(
        F.col("doc_id").alias(id_col),
        *[F.size(F.filter(base, lambda c: c["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)],  # noqa: B023
        F.sha2(told(base), 256).alias("base_sha256"), told(F.flatten(F.transform("found", redactor.selected))).alias("spans"))


def redact(docs: DataFrame, redactor: Redactor, text_col: str = "text", mark: str = "[PII]") -> DataFrame:
    """``docs`` with every selected span replaced by ``mark``; spans that overlap get one mark.

    All other columns, and null texts, stay as they are.
    """
    text = F.col(text_col)

    def clean(part: Column, found: Column) -> Column:
        def step(state: Column, c: Column) -> Column:
            fresh = c["start"] >= state["at"]
            gap = F.substring(part["body"], state["at"] - part["at"] + 1, c["start"] - state["at"])
            return F.struct(F.greatest(state["at"], c["stop"]).alias("at"),
                            F.when(fresh, F.concat(state["out"], gap, F.lit(mark))).otherwise(state["out"]).alias("out"))

        spans = F.array_sort(F.transform(redactor.selected(found), lambda c: F.struct(c["start"], c["stop"])))
        return F.aggregate(spans, F.struct(part["at"].alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(
            s["out"], F.substring(part["body"], s["at"] - part["at"] + 1, F.length(part["body"]))))

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_col].alias(text_col))
    cleaned = F.array_join(F.zip_with(_parts(text), "found", clean), "")
    return (
        held.withColumn("found", candidate_parts(text))
        .select("row", F.when(F.exists("found", lambda f: F.size(f) > 0), cleaned).otherwise(text).alias("cleaned"))
        .select(F.col("row").withField(text_col, F.col("cleaned")).alias("row")).select("row.*")
    )
