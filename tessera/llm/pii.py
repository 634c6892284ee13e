"""Personal data: fixed patterns, and gradient-boosted trees over proposed spans."""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import materialise

#: Fixed by the task's contract: the kinds in order.
KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns, made linear in the text: a repeat that nothing can follow does not give
#: back, and a run of one class is tried at its start only (or where the last match ended inside it).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be worth a try.
_HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: What the method proposes beside them: the contract's kinds, and secrets.
FOUND = (*KINDS, "secret")
#: High-recall generators of further spans, one or more for a kind; those of different patterns may overlap.
PROPOSED: tuple[tuple[str, str, str], ...] = (
    (
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[\[({<]\x20?at\x20?[\])}>])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({<]\x20?dot\x20?[\])}>]|\x20dot\x20)\x20?[A-Za-z0-9-]{2,}+)++",
        r"@|[\[({<]\x20?at\x20?[\])}>]",
    ),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]{2,}+)++", r"\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20|\.[a-z])"),
    ("ip", r"(?<![0-9A-Za-z:.\[\]])(?:(?:[0-9A-Fa-f]{1,4}::?){3,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\x20?(?:\[\.\]|\(\.\)|\.)\x20?[0-9]{1,3}){3})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9]\x20?[\[(]?\.[\])]?\x20?[0-9]"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20./_-]{0,2}[0-9]){12,18}(?![0-9A-Za-z])", r"[0-9](?:[\x20./_-]{0,2}[0-9]){12}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:\(?[0-9]|\(?00)[0-9\x20()./-]{6,18}[0-9](?![0-9A-Za-z])", r"[0-9][0-9\x20()./-]{6}"),
    ("phone", r"(?<![0-9A-Za-z+])(?:[01][-.\x20])?(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[-./\x20])[0-9]{3,4}[-.\x20][0-9]{3,4}(?![0-9A-Za-z]|[-.][0-9])", r"[0-9]\)?[-./\x20]?[0-9]{3,4}[-.\x20][0-9]{3}"),
    (
        "secret",
        r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]{16})[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*+={0,2}",
        r"[0-9][A-Za-z0-9+/_-]{7}|(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]{8,}+[0-9]",
    ),
)
#: Words that speak for a kind in the characters before a span, and words that speak against any. They are features, no filters.
_FOR = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|address|host|server|client|login|ping",
    "card": r"card|visa|master|amex|credit|payment|cc\b",
    "phone": r"phone|tel\b|call|mobile|cell|fax|dial|whatsapp|\bsms\b|number is|\bring\b|reception",
    "secret": r"token|secret|passw|\bkey\b|api.?key|bearer|credential|auth",
}
_AGAINST = r"order|invoice|version|isbn|serial|\bid\b|\bno\b|number of|page|score|build|release|hash|commit|section|price|total|digest|checksum|#\s*$|[$€£]\s*$"
_UNIT = r"^\s?(?:%|€|\$|km\b|kg\b|items|pages|points|units|votes|people|times)"
_TLD = r"(?i)(?:com|org|net|edu|gov|info|io|co|uk|de|fr|es|it|nl|eu)$"
_CONTEXT, _CHUNK = 32, 256
_SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
FEATURES = (
    *("kind", "length", "digits", "letters", "groups", "longest", "shortest", "separators", "spaces", "brackets", "dots", "colons", "largest", "first", "last", "zero_first", "bracket_first"),
    *("cue", "against", "unit", "luhn", "distinct", "glued", "tld", "capitals"),
)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _holds(kind: str, span: Column) -> Column:
    """The contract's further condition on a match."""
    if kind == "ip":
        parts = F.transform(F.split(span, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        digits = _digits(span)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(span)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: int, pattern: str, hint: str, holds) -> Column:
    """Leftmost non-overlapping matches that hold, with code point offsets.

    The text is split at the matches; offsets are running sums of the lengths of
    what lies between and of the matches themselves. A growing array is copied at
    each step, so matches are taken in chunks whose offsets are summed first.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        start = (acc["at"] + F.length(pair["gap"])).cast("int")
        end = (start + F.length(pair["hit"])).cast("int")
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("text"))
        return F.struct(end.alias("at"), F.when(holds(pair["hit"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(_SPAN)
    hits = F.filter(pairs, lambda p: p["hit"].isNotNull())
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(hits) - 1, F.lit(0)) / _CHUNK).cast("int")), lambda i: F.slice(hits, i * _CHUNK + 1, F.lit(_CHUNK)))
    wide = lambda chunk: F.aggregate(chunk, F.lit(0), lambda s, p: s + F.length(p["gap"]) + F.length(p["hit"]))
    starts = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + wide(c))))
    fold = lambda c: F.aggregate(c["chunk"], F.struct(c["start"].alias("at"), empty.alias("out")), step)["out"]
    found = F.flatten(F.transform(F.arrays_zip(chunks.alias("chunk"), F.slice(starts, 1, F.size(chunks)).alias("start")), fold))
    return F.when(F.coalesce(F.regexp_like(text, F.lit(hint)), F.lit(False)), found).otherwise(empty)


def base_spans(text: Column) -> list[Column]:
    """The contract's spans, an array for each kind."""
    return [_spans(text, i, BASE[k], _HINTS[k], lambda s, k=k: _holds(k, s)) for i, k in enumerate(KINDS)]


def proposed_spans(text: Column) -> Column:
    """Spans of the generators; they may overlap."""
    return F.concat(*[_spans(text, FOUND.index(k), pattern, hint, lambda s: F.lit(True)) for k, pattern, hint in PROPOSED])


def span_features(kind: Column, span: Column, left: Column, right: Column) -> list[Column]:
    """FEATURES of a span: its format, and what the text around it says."""
    digits, lower = _digits(span), F.lower(left)
    groups = F.filter(F.split(span, "[^0-9A-Za-z]+"), lambda g: g != "")
    sizes = F.transform(groups, F.length)
    cue = reduce(lambda other, i: F.when(kind == i, F.regexp_like(lower, F.lit(_FOR[FOUND[i]]))).otherwise(other), range(len(FOUND)), F.lit(False))
    only = lambda chars: F.length(F.regexp_replace(span, f"[^{chars}]", ""))
    found = [
        kind,
        F.length(span),
        F.length(digits),
        only("A-Za-z"),
        F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)),
        F.length(F.regexp_replace(span, "[0-9A-Za-z]", "")),
        only(r"\x20"),
        only(r"()\[\]{}<>"),
        only("."),
        only(":"),
        F.coalesce(F.array_max(F.transform(groups, lambda g: F.substring(g, 1, 6).try_cast("int"))), F.lit(-1)),
        F.length(F.get(groups, F.lit(0))),
        F.length(F.get(groups, F.size(groups) - 1)),
        F.startswith(digits, F.lit("0")),
        F.startswith(span, F.lit("(")),
        cue,
        F.regexp_like(lower, F.lit(_AGAINST)),
        F.regexp_like(right, F.lit(_UNIT)),
        F.when(F.length(digits).between(8, 24), luhn(digits)).otherwise(False),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.regexp_like(left, F.lit(r"[^\s(:;,>\"'=]$")),
        F.regexp_like(span, F.lit(_TLD)),
        only("A-Z"),
    ]
    return [F.coalesce(c.cast("double"), F.lit(0.0)) for c in found]


#: Formats of the labelled table (# is a digit, ~ one that completes a Luhn number, ? a small letter, ! a capital, % any hexadecimal digit): the first
#: ones are personal data unless the context speaks against it, the second ones only if it speaks for it, the last ones never.
FORMS: dict[str, tuple[tuple[str, ...], ...]] = {
    "phone": (
        ("(###) ###-####", "###-###-####", "(###)###-####", "(0##) ####-####", "(###) ### ####", "0##-###-####", "1-###-###-####", "00## ### #######", "1 (###) ###-####", "0### / ### ## ##", "(0###) ######", "(0##) ### ####", "0## / ### ## ##", "00## ## #######", "0#### / ######"),
        ("#### ######", "### ### ####", "##### ######", "###.###.####", "0## #### ####", "###.### ####", "##########", "0#### ######", "0#########", "0## ### ## ##", "###-####", "0# ## ## ## ##", "00###########"),
        ("19##-20## 10", "20##-0#-1# 1#", "20##-20## 1#", "####-####-####-####", "#### #### #### ####", "####.####.####.####", "################", "#################", "###############", "20## (###) ###-####", "## (###) ###-####", "19## (###) ###-####")
        + ("## ###-###-####", "20## ###-###-####", "#### ###-###-####", "# ### ### ###", "### ### ### ###", "## ### ### ###", "1. 2. 3. 4", "20##/0#/1# 20##", "20##/1#/0# 10##"),
    ),
    "card": (
        ("####.####.####.###~", "####/####/####/###~", "####.####.####.###~", "#### - #### - #### - ###~", "####_####_####_###~", "####/####/####/###~", "3###.######.####~"),
        ("####.####.####.####", "################", "#### #### #### ####", "#### ###### #####", "####-####-####-####", "###############", "####/####/####/####"),
        ("978-#-##-######-#", "20## 0# 1# ## ## ##", "### ### ### ### ###", "979-##-##-#####-#", "19## 1# 0# ## ## ##", "20##-0#-1# ##-##-##", "###.###.###.###.##", "##################", "###.###.###.###.###", "#.#.#.#.#.#.#.#.#.#.#.#.#", "#.#.##.#.#.#.#.#.#.#.#.#.#"),
    ),
    "ip": (
        ("2001:db8:%%:#:#:#", "1##[.]1##[.]#[.]##", "fe80:#:#:%%:%%%%:%%%%", "1#(.)##(.)#(.)##", "2a0#:%%%%:%%::%", "1##[.]##[.]1##[.]1##", "fe80::#:%%:%%%%:%%%%"),
        ("10.#. #. ##", "1## . ## . # . ##", "%%%%:%%%%:%%%%:%%%%"),
        ("#. #. #. ##", "1#:##:##:##", "#. #. #. #", "#. #.##.##", "##:##:##:##:##", "#:##:##:##", "#[.]#[.]#[.]#", "#:#:#:#", "1#:##:##:##:##", "#(.)#(.)#(.)#", "#:#:#:#:#", "##:##:##:##"),
    ),
    "email": (
        ("????.????? (at) ?????? (dot) com", "?????[at]?????[dot]org", "??????(at)????.com", "????.?? [at] ?????? [dot] net", "????## (at) ????.de", "????@????? . com", "???? @ ??????.org", "?????{at}????{dot}co", "????_?? at ?????? dot com", "???? at ??????.com"),
        ("???? at ?????? dot net", "???? @ ?????? . com", "???? at ??????.???"),
        ("???? at ????.?????", "??? at ?????? dot ????", "???? at ???.???????", "??? @ ##.##", "?? at ###.##", "?? at ##.##", "???? @ ???. ???", "??? at ?? dot ???????"),
    ),
    "secret": (
        ("%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "AKIA!#!!#!!#!#!!!#!!", "ghp_?#?!??#!?#??!?#!??#?!?#??!?#??!?#!", "sk-?#??#?!??#?#!?#??#?!??#?#!?", "eyJ?#?!??!#?#!?#??!?#!??#?!?#??!?#?!#!", "xoxb-############-?#?!??#!?#??!?#!"),
        ("%%%%%%%%-%%%%-%%%%-%%%%-%%%%%%%%%%%%", "?#?#?#??#?#?#?#??#", "%%%%%%%%%%%%%%%%", "?????-?????-##?#??-????#"),
        ("????????????-20##", "20##-##-##-????-????", "/????/??????/???##", "?????????_???????_#", "????????????????##", "################", "######################", "????????/????????/####", "+++++++++++++++##", "=======####======="),
    ),
}
#: Contexts of the labelled table: what stands before a span and behind it.
_SPEAKS_FOR: dict[str, tuple[tuple[str, str], ...]] = {
    "phone": (("please call me at ", " tomorrow"), ("my phone is ", "."), ("tel: ", ""), ("mobile ", ", thanks"), ("fax ", "."), ("my number is ", ""), ("whatsapp ", " any time"), ("you can dial ", "")),
    "card": (("card number ", " exp"), ("my visa is ", "."), ("credit card ", ""), ("paid by amex ", " on"), ("payment with ", " went"), ("charge my card: ", "")),
    "ip": (("ip address ", " was"), ("login from ", "."), ("the host ", " is down"), ("server ", ""), ("client ip ", ", port"), ("ping ", "")),
    "email": (("mail me: ", ""), ("contact ", " for"), ("write to ", "."), ("e-mail ", ""), ("reach me under ", " please"), ("my mail is ", "")),
    "secret": (('token = "', '"'), ("api_key=", ""), ("password: ", " "), ("secret ", "."), ("Authorization: Bearer ", ""), ("the access key ", " works")),
}
_NEUTRAL = (("and then the ", " was"), ("", ""), ("of the house ", " in"), ("she said ", "."), ("in the end ", ", and"), ("that is ", " for details"), ("we have ", " here"), ("they took ", " with them"), ("and so ", " it is"), ("der Text ", " und"), ("see ", ""), ("is hers. ", " is his"))
_SPEAKS_AGAINST = (("order no ", " was"), ("invoice ", "."), ("serial ", ""), ("isbn ", ""), ("version ", " is"), ("a price of $", " a year"), ("page ", ""), ("the build ", " failed"), ("commit ", " adds"), ("total ", " items"), ("score ", " points"), ("section ", ""))


def _labelled(draws: int, seed: int = 5) -> list[tuple[int, int, int, str, str, str]]:
    """(part, kind, label, span, left, right): every form in every context, ``draws`` times.

    Part 0 teaches; of part 1 either the form or the context is in no row of part 0.
    """
    rng, rows = random.Random(seed), []
    letters, capitals, hexes = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

    def fill(form: str) -> str:
        out = "".join(str(rng.randrange(10)) if c in "#~" else rng.choice({"?": letters, "!": capitals, "%": hexes}[c]) if c in "?!%" else c for c in form)
        if "~" not in form:
            return out
        at = form.index("~")
        digits = [int(c) for c in out if c.isdigit()]
        total = sum(2 * d - 9 * (d > 4) if i % 2 == 0 else d for i, d in enumerate(reversed(digits[:-1])))
        return f"{out[:at]}{-total % 10}{out[at + 1 :]}"

    for kind, groups in FORMS.items():
        contexts = [(1, x) for x in _SPEAKS_FOR[kind]] + [(0, x) for x in _NEUTRAL] + [(-1, x) for x in _SPEAKS_AGAINST]
        for evidence, forms in zip((2, 1, 0), groups, strict=True):
            for i, form in enumerate(forms):
                for j, (says, (left, right)) in enumerate(contexts):
                    label = int((evidence == 2 and says >= 0) or (evidence == 1 and says > 0))
                    part = int(i % 3 == 2 or j % 3 == 2)
                    rows += [(part, FOUND.index(kind), label, fill(form), left, right) for _ in range(draws)]
    return rows


def training_rows(spark: SparkSession, draws: int) -> DataFrame:
    """The labelled table (see ``_labelled``) as rows."""
    return spark.createDataFrame(_labelled(draws), "part int, kind int, label int, span string, left string, right string").coalesce(1)


def _tree_column(debug: str, features: list[Column]) -> Column:
    """A tree of the trained model, as nested conditions."""
    lines = [line.strip() for line in debug.splitlines() if line.strip().startswith(("If", "Else", "Predict"))]

    def node(at: int) -> tuple[Column, int]:
        if lines[at].startswith("Predict"):
            return F.lit(float(lines[at].split(":")[1])), at + 1
        feature, cut = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", lines[at]).groups()
        low, at = node(at + 1)
        high, at = node(at + 1)  # behind the Else
        return F.when(features[int(feature)] <= float(cut), low).otherwise(high), at

    return node(0)[0]


@dataclass(frozen=True)
class Model:
    """Boosted trees (weight and description) and the least probability of each kind."""

    trees: tuple[tuple[float, str], ...]
    least: tuple[float, ...]

    def probability(self, features: list[Column]) -> Column:
        margin = reduce(lambda a, b: a + b, [F.lit(weight) * _tree_column(debug, features) for weight, debug in self.trees])
        return 1 / (1 + F.exp(-2 * margin))


_MODELS: dict[tuple[str, int, float], Model] = {}


def train(spark: SparkSession, draws: int = 2, precision: float = 0.95) -> Model:
    """Boosted trees on the labelled table's part 0; thresholds are calibrated on its part 1.

    A kind's threshold is the least probability from which on at least ``precision`` of
    the spans of part 1, whose forms or contexts the trees have not seen, are personal data.
    """
    key = (spark.sparkContext.applicationId, draws, precision)
    if key not in _MODELS:
        names = [f"f{i}" for i in range(len(FEATURES))]
        spans = training_rows(spark, draws).select("part", "kind", "label", *[c.alias(n) for n, c in zip(names, span_features(*[F.col(n) for n in ("kind", "span", "left", "right")]), strict=True)])
        spans = materialise(spans, "labelled")
        taught = VectorAssembler(inputCols=names, outputCol="features").transform(spans.where("part = 0"))
        fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=12, maxDepth=5, stepSize=0.3, seed=7).fit(taught)
        model = Model(tuple((float(w), t.toDebugString) for w, t in zip(fitted.treeWeights, fitted.trees, strict=True)), ())
        scored = spans.where("part = 1").select("kind", "label", F.round(model.probability([F.col(n) for n in names]), 3).alias("p"))
        counts = scored.groupBy("kind", "p").agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy("kind", F.col("p").desc()).collect()  # of the labelled table
        least = []
        for i in range(len(FOUND)):
            n = good = 0
            best = 1.0
            for r in counts:
                if r.kind == i:
                    n, good = n + r.n, good + r.good
                    best = r.p if good >= precision * n else best
            least.append(float(max(0.5, best)))
        _MODELS[key] = Model(model.trees, tuple(least))
    return _MODELS[key]


def find_personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` (but one of that name) and a struct ``pii``: base (array for each kind), spans, secrets and redacted.

    ``spans`` has every base span and those proposed spans of the four kinds that do not
    touch one and whose calibrated probability is high enough, sorted by start, kind,
    end; ``secrets`` has those of keys and tokens. Of accepted spans that overlap, the most
    probable stays (then the longest, then the first). Start and end count code points, end exclusive. ``redacted`` is
    the text with each stretch of spans replaced by its first kind in brackets. A null text counts as empty.
    All of it is expressions on the one row: no shuffle, no explode, no Python. A span's features are
    computed once, as an array that the trees read.
    """
    model = model or train(docs.sparkSession)
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.struct(*[c for c in docs.columns if c.lower() != "pii"]).alias("__row"), F.col("text").alias("__text"))
    rows = rows.select("__row", "__text", *[c.alias(f"__{k}") for k, c in zip(KINDS, base_spans(text), strict=True)], F.array_distinct(proposed_spans(text)).alias("__more"))
    rows = rows.withColumn("__base", F.concat(*[F.col(f"__{k}") for k in KINDS]))
    least = F.array(*[F.lit(x) for x in model.least])

    def described(s: Column) -> Column:
        left = F.substring(text, F.greatest(s["start"] - _CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(_CONTEXT)))
        right = F.substring(text, s["end"] + 1, F.lit(16))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.array(*span_features(s["kind"], s["text"], left, right)).alias("f"))

    def scored(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), model.probability([s["f"][i] for i in range(len(FEATURES))]).alias("p"))

    def crosses(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    rank = lambda s: F.struct(s["p"], s["end"] - s["start"], -s["start"], -s["kind"])
    likely = F.filter(F.transform(F.transform("__more", described), scored), lambda s: s["p"] >= F.element_at(least, s["kind"] + 1))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,p:double>>")
    rows = rows.withColumn("__likely", F.when(F.size("__more") > 0, likely).otherwise(none))
    rows = rows.withColumn("__likely", F.filter("__likely", lambda s: ~F.exists("__base", lambda b: crosses(s, b))))
    rows = rows.withColumn("__added", F.filter("__likely", lambda s: ~F.exists("__likely", lambda o: crosses(s, o) & (rank(o) > rank(s)))))
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    everything = F.array_sort(F.concat(F.transform("__base", place), F.transform("__added", place)))
    spans, secrets = F.filter(everything, lambda s: s["kind"] < len(KINDS)), F.filter(everything, lambda s: s["kind"] == len(KINDS))
    names = F.array(*[F.lit(k) for k in FOUND])

    def hide(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

    hidden = F.aggregate(everything, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), hide)
    redacted = F.concat(hidden["out"], F.substring(text, hidden["at"] + 1, F.length(text)))
    added = F.size(F.filter("__added", lambda s: s["kind"] < len(KINDS))).cast("bigint")
    return rows.select("__row.*", F.struct(*[F.col(f"__{k}").alias(k) for k in KINDS], spans.alias("spans"), secrets.alias("secrets"), added.alias("n_added"), redacted.alias("redacted")).alias("pii"))


def span_list(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in FOUND])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
