"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators of high recall propose spans that may overlap: the base patterns (e-mail, IP address, card, phone), whatever their validators
say, looser ones of the same kinds (obfuscated addresses, IPv6, other card lengths and separators, national phone numbers), and ones of a fifth kind,
secrets (long mixed tokens, values of password-like keys). Format and context of a candidate are ``len(FEATURES)`` bits.

Boosted trees of depth two score the candidates. They are grown from labelled texts that ``labelled`` writes with DataFrame functions: templates of
real and of misleading uses, each a thousandfold with other digits and letters, with the truth marked, so labels aren't what a validator says.
Their candidates are counted as (fold, kind, bits, right) cells, of which there are few however many texts; on them the driver takes Newton steps on the
logistic loss. The templates are dealt to ``FOLDS`` folds, and the candidates of each are scored by trees that have seen none of its forms; for each kind the
threshold is the least such score at which ``PRECISION`` holds, so it says what happens to unseen forms. The trees of all folds come back as one
SQL expression, and documents are read in one pass without a shuffle.

The query's ``spans`` hold spans of the fifth kind too, named ``secret``, after those of the contract's four.

Base spans that pass their validator always stay. The other candidates that reach their kind's threshold are swept in order of their
starts: what overlaps a base span goes, and of two that overlap the one with the higher score stays.

Patterns are written so that each start of a run of characters is tried once, and lists of hits grow in blocks, so time is
near-linear in the text. Offsets are code points, ends exclusive.

Defined results: null text is empty (no spans, and stays null when redacted); null ids and repeated rows are kept one by one;
an empty table gives an empty result; further columns are ignored unless carried, and carried names
may clash with none of ours, as those are internal until the end.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, settle

KINDS = ("email", "ip", "card", "phone", "secret")
PRECISION, SUPPORT = 0.95, 20
ROUNDS, RATE = 40, 0.3
#: Texts that the trees are grown from, and parts of the templates that take turns in setting the thresholds.
LABELLED, FOLDS = 6_000, 4
#: Characters before and after a candidate that its features see.
BEFORE, AFTER = 32, 8
#: Elements that a list grows by one by one before they are put together.
BLOCK = 256


@dataclass(frozen=True)
class Generator:
    kind: int
    base: bool
    #: Text without this has no match; cheaper to look for. A pattern, but for a single character.
    needs: str
    pattern: str


# The patterns. A base pattern finds just what its plain form finds from left to right, or of that
# only what may be valid; where a run of its first characters has failed or been used up, no later start in it is tried.
GENERATORS = (
    Generator(0, True, "@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"),
    Generator(1, True, ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Generator(2, True, "[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"),
    Generator(3, True, "+", r"\+[0-9][ ().0-9-]+[0-9]"),
    Generator(0, False, r"(?i)[\[( ]at[\]) ]", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[( ]at[\]) ] ?[a-z0-9-]{1,63}+ ?(?:[\[( ]dot[\]) ]|\.) ?[a-z]{2,10}(?![a-z0-9])"),
    Generator(1, False, ":", r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}+(?![0-9A-Fa-f:])"),
    Generator(2, False, "[0-9]", r"(?<![0-9])(?<![0-9][ .-])[0-9](?:[ .-]?[0-9]){12,18}+(?![ .-]?[0-9])"),
    Generator(3, False, "[0-9]", r"(?<![0-9+().-])(?<![0-9+] )(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,4}){2,4}+(?![0-9./-])"),
    Generator(4, False, "[0-9]", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"),
    Generator(4, False, r"(?i)(?:passw|pwd|secret|token|key)", r"(?i)(?<=(?:password|passwd|pwd|secret|token|key)[\"']?\s?[=:]\s?[\"']?)[^\s\"'=:]{6,}+"),
)
# The words around a candidate that tell for and against a kind, in English, German, French and Spanish.
_PHONE_CUES = r"(?i)(call|tel|phone|fax|mobile|cell|sms|reach|ring|anruf|mobil|appel|portable|llam)[^0-9]*$"
_CARD_CUES = r"(?i)(card|visa|amex|mastercard|credit|debit|karte|carte|tarjeta|pay)[^0-9]*$"
_NET_CUES = r"(?i)(\bip\b|host|server|login|address|adress|client|node|ping|ssh)[^0-9]*$"
_SECRET_CUES = r"(?i)(token|key|secret|passw|pwd|auth|bearer|credential)[^a-z0-9]{0,12}$"
_MAIL_CUES = r"(?i)(mail|write|contact|reach|send|schreib|kontakt|écri|contacto|address)\W*\w*\W*$"
_OTHER_CUES = r"(?i)(order|invoice|version|release|isbn|issn|sku|track|part|serial|ref|ticket|build|commit|sha|md5|page|chapter|section|figure|doi|bestell|commande|pedido|rechnung|facture|\bid\b|\bno\b|\bv|#)[^a-z]{0,6}$"
_DIGITS = lambda h: F.length(F.regexp_replace(h, "[^0-9]", ""))
# The features, each a condition on (before, hit, after).
FEATURES: tuple[Callable[[Column, Column, Column], Column], ...] = (
    lambda b, h, a: b.rlike(r"(^|[\s(\[<\"':;,=])$"),
    lambda b, h, a: a.rlike(r"^($|[\s)\]>\"':;,.!?])"),
    lambda b, h, a: h.rlike(r"[ ()-]"),
    lambda b, h, a: b.rlike(_PHONE_CUES),
    lambda b, h, a: b.rlike(_CARD_CUES),
    lambda b, h, a: b.rlike(_NET_CUES),
    lambda b, h, a: b.rlike(_SECRET_CUES),
    lambda b, h, a: b.rlike(_MAIL_CUES),
    lambda b, h, a: b.rlike(_OTHER_CUES),
    lambda b, h, a: b.rlike(r"[=:]\s?[\"']?$"),
    lambda b, h, a: _DIGITS(h).between(10, 12),
    lambda b, h, a: _DIGITS(h).between(13, 19),
    lambda b, h, a: h.rlike(r"[A-Za-z]") & h.rlike(r"[0-9]"),
    lambda b, h, a: (_DIGITS(h) >= 12) & _luhn(h),
    lambda b, h, a: h.rlike(r"(.)\1{3}"),
    lambda b, h, a: h.rlike(r"(?i)[\[(](at|dot)[\])]"),
    lambda b, h, a: h.rlike(r"(?i) dot [a-z]+$"),
    lambda b, h, a: h.rlike(r"^(?:[0-9A-Fa-f]{2}:)*[0-9A-Fa-f]{2}$"),
)
_FOUND = "struct<kind:int,base:boolean,valid:boolean,start:int,end:int,bits:int>"

# The labelled texts. # stands for a digit, % for one of 0-9a-f, & for a small letter, ^ for a letter or digit, ~ for the digit that makes the
# digits of the marked span pass Luhn; what stands between { and } is personal data of the kind. In a text without marks nothing is.
TRUE_TEXTS = {
    "email": (
        "write to {&&&&.&&&& [at] &&&&&&& [dot] com} today", "contact: {&&&&&## (at) &&&&.org}", "you can mail {&&&_&&& at &&&&&& dot net} for it", "schreiben Sie an {&&&& [at] &&&&&&.de}", "send it to {&&&&.&&&@&&&&&.com} please",
        "écrivez à {&&&&& (at) &&&&& (dot) fr}", "contacto {&&&& [AT] &&&&& [DOT] es}", "e-mail {&&&&&& [at] &&&&&&&&.edu}", "reach me: {&&&&## at &&&&& dot com}",
    ),
    "ip": (
        "login from {%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%} failed", "client address {%%%%:%%%::%%%%:%%%%}", "ssh {%%%%:%%%%:%:%::%%}", "host {1##.1##.##.#} is up", "the server at {%%%%:%%%%::%%%%:%%} answered", "ping {%%%%:%%:%%%:%%%%:%:%:%%%%:%%}",
    ),
    "card": (
        "my card is {####-####-####-###~}", "Visa {4### #### #### ###~} exp 09/27", "credit card number: {37## ###### ####~}", "pay with {34############~}", "card {#### #### #### ###~}", "carte {####.####.####.###~}", "Karte Nr {5##############~}",
        "tarjeta {4###-####-####-###~}", "amex {37##-######-####~} please", "charged to {4##############~} yesterday",
    ),
    "phone": (
        "call {(###) ###-####} today", "tel. {0## ### ####}", "phone: {###-###-####}", "mobile {00## ### ### ###}", "Anruf {0### ### ## ##}", "appelez le {0# ## ## ## ##}", "llame al {### ### ###}", "fax {###.###.####}", "reach me on {(0##) #### ####}",
        "text or call {### ### ####}", "Tel: {0049 ### ### ###}", "cell {(###) ###.####}",
    ),
    "secret": (
        "api_key: {^^^^^^^^^^^^^^^^^^^^^^^^}", "secret={&&&&##&&&&#&}", "password: {&&&&&&##}", "export AUTH_TOKEN={^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^^}", "Authorization: Bearer {^^^^^^^^^^^^^^^^^^^^^^^^^^^^#^^^}", "pwd = '{&&##&&##&&}'",
        "access key {AK^^^^^^^^^^^^^^#^^^}", "his token {%%%%%%%%%%%%%%%%%%%%#%%%%%%%%%%%%} leaked",
    ),
}
FALSE_TEXTS = {
    "email": (
        "we met at &&&&&.&&& yesterday", "look at this. It works", "at noon (at &&&&.&&&)", "he sat at &&&&& dot matrix printers", "a stop at &&&&&&.in the town", "&&&&& at &&&&& dot &&&&&& lines", "good at &&&&&&.so they said", "price (at &&& dot com era)", "images &&&@2x here",
    ),
    "ip": (
        "version #.##.#.### is out", "build 4##.3##.999.1 of it", "the MAC %%:%%:%%:%%:%%:%%", "from ##:##:##:## to now", "section #.#.#.#", "ratio #:##:#:##:#", "Release 10.#.###.####", "at ##:##:##:### on the tape", "figure #.#.##.#", "device %%:%%:%%:%%:%%:%% found",
    ),
    "card": (
        "order ################ shipped", "tracking ####-####-####-####", "ISBN ###-#-##-######-#", "invoice no ###############", "the constant 0.################", "timestamp #############", "serial ################", "phrase of #### #### #### #### counts", "ref ##############-##", "Rechnung ################", "pi is 3.1415926535897##",
        "id ################", "the sum ################ came", "code ################ here",
    ),
    "phone": (
        "on ####-##-## we met", "scores ## ## ## ##", "pages ###-### ###", "order ###-###-####", "version ##.##.###", "dates ##/##/#### and ##.##.####", "part no ### ### ###", "figures ### ### ### in all", "ISBN ### ## ### ####", "between #### ## ##", "ticket ###-####-###", "a total of ### ### ### dollars", "chapter ##.##.##",
    ),
    "secret": (
        "commit %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "sha %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "the number ################ is", "see /usr/lib/python3/dist-packages/&&&&&&&&", "&&&&&&&&-&&&&-2-&&&&&&&& words", "the key: &&&&&&&", "order ##################", "id %%%%%%%%-%%%%-%%%%-%%%%-%%%%%%%%%%%%", "keyword: &&&&&&&&",
        "the secret: &&&&&&&& is that", "md5 of it: %%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%%", "page2/&&&&&&&&/&&&&&&/&&&&.html", "monkey=&&&&&&",
    ),
}


def _luhn(hit: Column) -> Column:
    digits = F.reverse(F.regexp_replace(hit, "[^0-9]", ""))

    def add(acc: Column, i: Column) -> Column:
        digit = F.substr(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return acc + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: int, hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    if KINDS[kind] == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: part.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if KINDS[kind] == "card":
        return digits.between(16, 19) & _luhn(hit)
    return digits.between(8, 15) if KINDS[kind] == "phone" else F.lit(True)


def _running(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, last: Callable[[Column], Column] | None = None) -> Column:
    """All elements (arrays of the type ``kind``) that ``step(state, item) -> (state, elements)`` gives over ``items`` from the state ``first``, and those of ``last(state)``."""
    none = lambda of: F.array().cast(f"array<{of}>")
    state = lambda s, out: F.struct(s.alias("s"), out.alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / BLOCK).cast("int")), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))

    def one(acc: Column, x: Column) -> Column:
        s, more = step(acc["s"], x)
        return state(s, F.concat(acc["out"], more))

    def block(acc: Column, own: Column) -> Column:
        return F.aggregate(own, state(acc["s"], none(kind)), one, lambda got: state(got["s"], F.concat(acc["out"], F.array(got["out"]))))

    def finish(acc: Column) -> Column:
        return F.flatten(acc["out"]) if last is None else F.concat(F.flatten(acc["out"]), last(acc["s"]))

    return F.aggregate(blocks, state(first, none(f"array<{kind}>")), block, finish)


def candidates(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the column _found: all candidates in the column ``text`` (not null)."""
    some = lambda i: F.size(f"_h{i}") > 0
    hits = {}
    for i, g in enumerate(GENERATORS):
        needed = F.col(text).rlike(g.needs) if len(g.needs) > 1 else F.contains(F.col(text), F.lit(g.needs))
        hits[f"_h{i}"] = F.when(needed, F.regexp_extract_all(F.col(text), F.lit(g.pattern), 0)).otherwise(F.array().cast("array<string>"))
    out = docs.withColumns(hits).withColumns({f"_p{i}": F.when(some(i), F.split(F.col(text), g.pattern, -1)) for i, g in enumerate(GENERATORS)})

    def located(i: int, g: Generator) -> Column:
        hits, pieces = F.col(f"_h{i}"), F.col(f"_p{i}")
        zipped = F.arrays_zip(hits.alias("hit"), F.slice(pieces, F.lit(1), F.size(hits)).alias("left"), F.slice(pieces, F.lit(2), F.size(hits)).alias("right"))
        renamed = F.transform(zipped, lambda z: F.struct(z["hit"].alias("hit"), z["left"].alias("left"), z["right"].alias("right")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["left"])
            end = start + F.length(x["hit"])
            before, after = F.right(x["left"], F.lit(BEFORE)), F.left(x["right"], F.lit(AFTER))
            bits = sum((F.when(f(before, x["hit"], after), F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(FEATURES)), F.lit(0))
            one = F.struct(F.lit(g.kind).alias("kind"), F.lit(g.base).alias("base"), (_valid(g.kind, x["hit"]) if g.base else F.lit(False)).alias("valid"), start.alias("start"), end.alias("end"), bits.alias("bits"))
            return end, F.array(one.cast(_FOUND))

        return F.when(some(i), _running(renamed, F.lit(0), step, _FOUND)).otherwise(F.array().cast(f"array<{_FOUND}>"))

    names = [f"_{x}{i}" for i in range(len(GENERATORS)) for x in "hp"]
    return out.withColumn("_found", F.concat(*[located(i, g) for i, g in enumerate(GENERATORS)])).drop(*names)


def labelled(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """text, kind, fold, start, end (of the marked span, -1 if nothing is): so many texts from the templates, with filler around them."""
    texts = [(k, t, i % FOLDS) for k, kind in enumerate(KINDS) for own in (TRUE_TEXTS[kind], FALSE_TEXTS[kind]) for i, t in enumerate(own)]
    pick = lambda salt, n: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    table = spark.range(rows).withColumn("which", pick("text", len(texts)))
    table = table.withColumns({name: F.get(F.array(*[F.lit(t[i]) for t in texts]), "which") for i, name in enumerate(("kind", "form", "fold"))})

    def letter(c: Column, i: Column) -> Column:
        h = F.xxhash64(F.col("id"), F.lit(seed), i)
        of = lambda chars: F.substr(F.lit(chars), F.pmod(h, F.lit(len(chars))).cast("int") + 1, F.lit(1))
        small = "abcdefghijklmnopqrstuvwxyz"
        return F.when(c == "#", of("0123456789")).when(c == "%", of("0123456789abcdef")).when(c == "&", of(small)).when(c == "^", of(small + small.upper() + "0123456789")).otherwise(c)

    filled = table.withColumn("filled", F.array_join(F.transform(F.split("form", ""), letter), ""))
    span = F.regexp_extract("filled", r"\{([^}]*)\}", 1)
    digit = F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: _luhn(F.replace(span, F.lit("~"), d.cast("string")))), F.lit(0)).cast("string")
    filled = filled.withColumn("filled", F.when(F.contains("filled", F.lit("~")), F.replace("filled", F.lit("~"), F.coalesce(digit, F.lit("0")))).otherwise(F.col("filled")))
    fill = F.array(*[F.lit(x) for x in ("", "The rest is as it was. ", "Und so weiter, ", "oui, ", "Ya veremos: ", "2 of 3 ")])
    lead = F.get(fill, pick("lead", 6))
    whole = F.concat(lead, F.col("filled"), F.get(F.array(*[F.lit(x) for x in ("", " and more", ".", ", then.", "\nNext line")]), pick("tail", 5)))
    at = F.instr(whole, "{") - 1
    end = F.instr(whole, "}") - 2
    return filled.select(F.translate(whole, "{}", "").alias("text"), "kind", "fold", F.when(at >= 0, at).otherwise(-1).alias("start"), F.when(at >= 0, end).otherwise(-1).alias("end"))


class SpanModel:
    """Boosted trees of depth two over (kind, bits) and a threshold for each kind."""

    def __init__(self) -> None:
        self.trees: list[tuple] = []  # (feature, (feature, leaf, leaf) if unset, the same if set)
        self.thresholds = [math.inf] * len(KINDS)
        self.bias = 0.0
        #: Precision, and recall among the candidates, of each kind on forms that the trees hadn't seen.
        self.shown: dict[str, tuple[float, float]] = {}

    def score(self, x: int) -> float:
        out = self.bias
        for root, unset, is_set in self.trees:
            f, low, high = is_set if x >> root & 1 else unset
            out += high if x >> f & 1 else low
        return out

    def expression(self, x: Column) -> Column:
        """The score as a SQL expression over the packed bits; a sum of CASEs."""
        has = lambda f: x.bitwiseAND(F.lit(1 << f)) != 0
        leaf = lambda f, low, high: F.when(has(f), F.lit(high)).otherwise(F.lit(low))
        return sum((F.when(has(root), leaf(*is_set)).otherwise(leaf(*unset)) for root, unset, is_set in self.trees), F.lit(self.bias))


def packed(kind, bits):
    """Bits of a candidate with its kind as further bits; of ints or columns."""
    if isinstance(kind, Column):
        return bits + F.get(F.array(*[F.lit(packed(k, 0)) for k in range(len(KINDS))]), kind)
    return bits + ((1 << kind) << len(FEATURES))


def boost(cells: list[tuple[int, int, int]], rounds: int = ROUNDS, rate: float = RATE) -> SpanModel:
    """From cells (packed bits, right, wrong)."""
    model, width = SpanModel(), len(FEATURES) + len(KINDS)
    right, wrong = (np.array([c[i] for c in cells], float) for i in (1, 2))
    if not right.sum() + wrong.sum():
        return model
    model.bias = math.log((right.sum() + 1) / (wrong.sum() + 1))
    has = np.array([[x >> f & 1 for f in range(width)] for x, _, _ in cells], bool)
    score = np.full(len(cells), model.bias)

    def stump(g: np.ndarray, h: np.ndarray) -> tuple[float, tuple]:
        set_g, set_h = g @ has, h @ has
        rest_g, rest_h = g.sum() - set_g, h.sum() - set_h
        gain = set_g**2 / (set_h + 1) + rest_g**2 / (rest_h + 1)
        f = int(gain.argmax())
        return float(gain[f]), (f, float(rate * rest_g[f] / (rest_h[f] + 1)), float(rate * set_g[f] / (set_h[f] + 1)))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = right - p * (right + wrong), p * (1 - p) * (right + wrong)
        splits = []
        for f in range(width):
            (a, unset), (b, is_set) = stump(g * ~has[:, f], h * ~has[:, f]), stump(g * has[:, f], h * has[:, f])
            splits.append((a + b, -f, (f, unset, is_set)))
        model.trees.append(max(splits)[2])
        root, unset, is_set = model.trees[-1]
        for side, (f, low, high) in ((False, unset), (True, is_set)):
            score += (has[:, root] == side) * np.where(has[:, f], high, low)
    return model


def calibrate(model: SpanModel, cells: list[tuple[int, int, int, int]], precision: float = PRECISION, support: int = SUPPORT) -> None:
    """Set the thresholds from held-out cells (kind, bits, right, wrong)."""
    limits(model, [(kind, model.score(packed(kind, bits)), good, bad) for kind, bits, good, bad in cells], precision, support)


def limits(model: SpanModel, scored: list[tuple[int, float, int, int]], precision: float = PRECISION, support: int = SUPPORT) -> None:
    """Set the thresholds from (kind, score, right, wrong): the least score from which on so many are right, and never one that says wrong is likelier; and what they show there."""
    for kind in range(len(KINDS)):
        every = sum(good for k, _, good, _ in scored if k == kind)
        own = sorted((x[1:] for x in scored if x[0] == kind and x[1] >= 0), reverse=True)
        good = bad = 0
        for i, (score, g, b) in enumerate(own):
            good, bad = good + g, bad + b
            if (i + 1 == len(own) or own[i + 1][0] < score) and good + bad >= support and good >= precision * (good + bad):
                model.thresholds[kind] = score
                model.shown[KINDS[kind]] = (good / (good + bad), good / max(1, every))


def _cells(texts: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(fold, kind, bits, right, wrong) of the candidates in labelled texts; right is what covers the marked span of its kind and little else."""
    found = settle(candidates(texts, "text").select("fold", "kind", "start", "end", "_found"), "labelled")  # else the optimizer goes through all of it again for each use
    one = found.select("fold", "kind", "start", "end", F.explode("_found").alias("c"))
    right = (F.col("c.kind") == F.col("kind")) & (F.col("start") >= 0) & (F.abs(F.col("c.start") - F.col("start")) <= 2) & (F.abs(F.col("c.end") - F.col("end")) <= 2)
    counts = one.groupBy("fold", "c.kind", "c.bits").agg(F.count_if(right).alias("right"), F.count_if(~right).alias("wrong")).collect()  # a row per fold, kind and combination of features that occurs
    discard(found)
    return [tuple(r) for r in sorted(counts)]


_models: dict[tuple, SpanModel] = {}


def learned(spark: SparkSession, rows: int = LABELLED) -> SpanModel:
    """The model, grown and calibrated once in a session."""
    key = (spark.sparkContext.applicationId, rows)
    if key not in _models:
        _models[key] = grown(_cells(labelled(spark, rows, 1)))
    return _models[key]


def grown(cells: list[tuple[int, int, int, int, int]]) -> SpanModel:
    """The trees of all cells, with thresholds from the scores that each fold gets from trees of the others."""
    trees = lambda own: boost([(packed(k, bits), good, bad) for _, k, bits, good, bad in own])
    model, scored = trees(cells), []
    for fold in range(FOLDS):
        part = trees([c for c in cells if c[0] != fold])
        scored += [(k, part.score(packed(k, bits)), good, bad) for f, k, bits, good, bad in cells if f == fold]
    limits(model, scored)
    return model


def _selected(model: SpanModel) -> tuple[Column, Column]:
    """(base spans, further spans) from _found, as (kind, start, end) in the order of starts."""
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.filter("_found", lambda c: c["valid"])
    limit = lambda c: F.get(F.array(*[F.lit(float(t)) for t in model.thresholds]), c["kind"])
    scored = F.transform(F.filter("_found", lambda c: ~c["valid"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.expression(packed(c["kind"], c["bits"])).alias("score"), limit(c).alias("limit")))
    likely = F.transform(F.filter(scored, lambda c: c["score"] >= c["limit"] - 1e-9), lambda c: F.struct(c["start"], c["end"], c["kind"], c["score"]))
    always = F.transform(base, lambda c: F.struct(c["start"], c["end"], c["kind"], F.lit(math.inf).alias("score")))
    kind = "struct<start:int,end:int,kind:int,score:double>"
    none = F.lit(None).cast(kind)

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        """s: reach (the furthest end of a base span so far) and held (the best further span of those that overlap, or null)."""
        held, sure = s["held"], x["score"] == math.inf
        touches = held.isNotNull() & (held["end"] > x["start"])
        goes = ~sure & (x["start"] < s["reach"])  # overlaps a base span
        now = F.when(sure, none).when(goes, held).when(touches & (held["score"] >= x["score"]), held).otherwise(x)
        out = held.isNotNull() & ~touches & ~goes
        return F.struct(F.when(sure, F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"), now.alias("held")), F.when(out, F.array(held)).otherwise(F.array().cast(f"array<{kind}>"))

    first = F.struct(F.lit(0).alias("reach"), none.alias("held"))
    last = lambda s: F.when(s["held"].isNotNull(), F.array(s["held"])).otherwise(F.array().cast(f"array<{kind}>"))
    more = F.when(F.size(likely) > 0, _running(F.array_sort(F.concat(always.cast(f"array<{kind}>"), likely.cast(f"array<{kind}>"))), first, step, kind, last)).otherwise(F.array().cast(f"array<{kind}>"))
    return F.transform(base, plain), F.transform(more, plain)


def find_pii(docs: DataFrame, *, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, ``carry`` columns as _c0, _c1, ..., and _base and _more: arrays of spans (kind, start, end)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    base, more = _selected(learned(docs.sparkSession))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    some = F.size("_found") > 0
    return candidates(rows, "_text").withColumn("_base", F.when(some, base).otherwise(none)).withColumn("_more", F.when(some, more).otherwise(none)).drop("_found")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["kind"], c["start"], c["end"])))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.get(kinds, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans, and how many these are."""
    found = find_pii(docs, id_col=id_col, text_col=text_col)
    count = lambda k: F.size(F.filter("_base", lambda c: c["kind"] == k)).cast("long")
    return found.select(
        F.col("_id").alias(id_col),
        *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.concat("_base", "_more")).alias("spans"),
        (F.size("_base") + F.size("_more")).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each selected span replaced by its kind in brackets; of spans that overlap the first gives the name; null stays null."""
    carried = tuple(docs.columns)
    found = find_pii(docs, carry=carried, id_col=id_col, text_col=text_col)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.transform(F.concat("_base", "_more"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    kind = "struct<start:int,end:int,kind:int>"
    none = F.array().cast(f"array<{kind}>")

    def step(held: Column, x: Column) -> tuple[Column, Column]:
        """Overlapping spans as one."""
        touches = held.isNotNull() & (x["start"] < held["end"])
        one = F.struct(held["start"].alias("start"), F.greatest(held["end"], x["end"]).alias("end"), held["kind"].alias("kind"))
        return F.when(touches, one).otherwise(x), F.when(held.isNotNull() & ~touches, F.array(held)).otherwise(none)

    merged = _running(spans.cast(f"array<{kind}>"), F.lit(None).cast(kind), step, kind, lambda held: F.when(held.isNotNull(), F.array(held)).otherwise(none))
    rows = found.withColumn("_spans", F.when(F.size("_base") + F.size("_more") > 0, merged).otherwise(none))
    begins, stops = F.concat(F.array(F.lit(0)), F.transform("_spans", lambda x: x["end"])), F.concat(F.transform("_spans", lambda x: x["start"]), F.array(F.length("_text")))
    between = F.zip_with(begins, stops, lambda a, z: F.substr(F.col("_text"), a + 1, z - a))
    labels = F.concat(F.transform("_spans", lambda x: F.get(names, x["kind"])), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(between, labels, lambda rest, name: F.concat(rest, name)), "")
    k = carried.index(text_col)
    text = F.when(F.size("_spans") > 0, joined).otherwise(F.col(f"_c{k}"))
    return rows.select(*[(text if i == k else F.col(f"_c{i}")).alias(c) for i, c in enumerate(carried)])
