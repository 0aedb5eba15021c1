"""Personal data: fixed rules, and weakly supervised spans beside them.

Everything that touches rows is DataFrame functions. A pattern's places come
from the text split by it: a match starts behind all pieces and matches before.
Sums over those are taken in blocks, so the work grows with the number of
matches and hardly with its square.

Fixed kinds (email, ip, card, phone) are patterns with a check on each match.
Beyond them, loose patterns give candidates in what the fixed spans leave of
the text; three labelers vote on each (+1, 0 or -1): strict formats and check
digits, gazetteers, and words around it. Counts of vote patterns over the whole
corpus go through expectation-maximisation, which estimates how reliable each
labeler is and how likely each pattern is personal data; with those likelihoods
as soft labels a naive Bayes classifier over span features is trained, and it
alone decides which candidates become spans. Both models see only tables of
counts whose size is bounded by the number of patterns.

Patterns carry guards that keep them linear on long runs: a match may begin at
the previous match's end or where its first class begins, never within it,
which is where an unguarded search would find it, too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

LOCAL, HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?={LOCAL})(?:\G|(?<!{LOCAL})){LOCAL}++@{HOST}++(?:\.{HOST}++)++"
IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
KINDS = ("email", "ip", "card", "phone")

# Gazetteers and cue words (fixed values).
ENDINGS = "com org net edu gov info biz io co de fr es at ch uk us eu it nl be pt ru pl jp cn in br ca au se no dk fi cz gr ie mx".split()
PREFIXES = "34 37 36 38 30 51 52 53 54 55 40 41 42 43 44 45 46 47 48 49 555 800 888 877 866 001 0049 0033 0034 0041 0043 0044".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR IE IT LU NL NO PL PT SE".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame Signor Signora".split()
GIVEN = "Anna Anne Maria Marie Julia Laura Sarah Emma Elena Carmen Sofia Peter Paul Thomas Michael Martin Hans Karl Jean Pierre Louis Juan José Carlos Luis Pedro James John Robert David William Mary Linda Susan".split()
STREETS = "Street Road Avenue Lane Drive Square Boulevard St Rd Ave Ln Blvd".split()
CUES = "mail email e-mail contact write phone tel telefon telefono téléphone call fax mobile card visa iban ssn social passport account konto cuenta compte name named dear address adresse lives patient".split()
AGAINST = "version isbn issn order total price page seite page pagina figure table build release".split()
AROUND = 32  # characters before a candidate in which cue words count

# Loose patterns: an address, perhaps spelled out; digits in groups; a name with a title; a street with a number; a bank account.
ADDRESS = rf"(?={LOCAL})(?:\G|(?<!{LOCAL})){LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?{HOST}++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{{2,}}+)++"
NUMBER = r"(?=[0-9(])(?:\G|(?<![0-9]))\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+"
NAME = rf"(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?"
STREET = rf"(?<![0-9])[0-9]{{1,5}}\x20(?:\p{{Lu}}\p{{Ll}}++\x20){{1,3}}?(?:{'|'.join(STREETS)})(?![\p{{L}}])|(?<![\p{{L}}])\p{{Lu}}\p{{Ll}}{{0,40}}(?:straße|strasse|weg|platz|gasse)\x20[0-9]{{1,4}}(?![0-9])"
ACCOUNT = r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])"
LOOSE = {"address": ADDRESS, "number": NUMBER, "name": NAME, "street": STREET, "account": ACCOUNT}
BLOCK = 7  # places are summed over 2**BLOCK at once
PIECE = 6  # texts are cut into pieces of 2**PIECE code points
_MATCHES = "array<struct<start:int,end:int,value:string>>"


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(a: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element what merge makes of all elements before it; by blocks, for arrays that are not empty."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, start, merge)

    n = 1 << BLOCK

    def each(a: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(a) - 1, BLOCK)), lambda b: fold(F.slice(a, b * n + 1, F.lit(n))))
        before = lambda u: F.transform(u, lambda _, i: fold(F.slice(u, F.lit(1), i)))
        within = lambda i: fold(F.slice(a, F.shiftright(i, BLOCK) * n + 1, i.bitwiseAND(F.lit(n - 1))))
        return let(let(blocks, before), lambda up: F.transform(a, lambda _, i: merge(F.get(up, F.shiftright(i, BLOCK)), within(i))))

    return let(a, each)


def places(text: Column, pattern: str, worth: Column) -> Column:
    """Array of (start, end, value) of a pattern's successive matches, in code points; texts not worth it have none."""

    def matches(m: Column) -> Column:
        gaps = F.transform(m["between"], lambda b: F.length(b))
        steps = F.transform(m["found"], lambda f, i: F.length(F.get(m["between"], i)) + F.length(f))
        at = running(steps, F.lit(0), lambda x, y: x + y)
        one = lambda g, x: F.transform(m["found"], lambda f, i: F.struct((F.get(x, i) + F.get(g, i)).alias("start"), (F.get(x, i) + F.get(g, i) + F.length(f)).alias("end"), f.alias("value")))
        return let(gaps, lambda g: let(at, lambda x: one(g, x)))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(worth & text.rlike(pattern), let(both, matches)).otherwise(empty(_MATCHES))


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << PIECE}}}"), F.lit(0))


def part(cut: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (start at least 0) of a text's pieces; the cost follows the part and not its place."""
    first = F.shiftright(start, PIECE)
    some = F.array_join(F.slice(cut, first + 1, F.shiftright(F.greatest(end - 1, start), PIECE) - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * (1 << PIECE) + 1, end - start)).otherwise("")


def replaced(text: Column, spans: Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with its spans (structs that begin with start; at least one) cut out.

    In their place stands by(span, how many code points no span before it
    covers, whether it begins outside all spans before it).
    """

    def cut_out(x: Column) -> Column:
        put = F.transform(x["spans"], lambda s, i: F.concat(part(x["cut"], F.get(x["reach"], i), s["start"]), by(s, F.greatest(s["end"] - F.greatest(s["start"], F.get(x["reach"], i)), F.lit(0)), s["start"] >= F.get(x["reach"], i))))
        return F.concat(F.array_join(put, ""), part(x["cut"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), F.length(text)))

    reach = lambda s: running(F.transform(s, lambda m: m["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
    return let(F.array_sort(spans), lambda s: let(F.struct(s.alias("spans"), reach(s).alias("reach"), pieces(text).alias("cut")), cut_out))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", digits(c))


def fixed_kinds(text: Column) -> dict[str, Column]:
    """The fixed kinds' matches that pass their checks."""
    has_digit, has_at, has_plus = text.rlike("[0-9]"), F.contains(text, F.lit("@")), F.contains(text, F.lit("+"))
    n = lambda m: F.length(digits(m["value"]))
    return {
        "email": places(text, EMAIL, has_at),
        "ip": F.filter(places(text, IP, has_digit), lambda m: m["value"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")),
        "card": F.filter(places(text, CARD, has_digit), lambda m: n(m).between(16, 19) & luhn(m["value"])),
        "phone": F.filter(places(text, PHONE, has_plus), lambda m: n(m).between(8, 15)),
    }


def account_check(value: Column) -> Column:
    """Whether an account number's check digits are right: letters as two digits, remainder 1 by 97."""
    v = F.regexp_replace(value, "\\x20", "")
    turned = F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))
    letter = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    numbers = F.transform(F.regexp_extract_all(turned, F.lit("."), F.lit(0)), letter)
    return F.aggregate(numbers, F.lit(0), lambda a, d: F.when(d > 9, a * 100 + d).otherwise(a * 10 + d) % 97) == 1


def votes(m: Column, loose: str, before: Column) -> dict[str, Column]:
    """The labelers' votes on a candidate, and features of its form; `before`: the characters before it, in lower case."""
    value = m["value"]
    cue = lambda words: before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(words)})(?:[^\p{{L}}]|$)")
    context = F.when(cue(CUES), 1).when(cue(AGAINST), -1).otherwise(0)
    d = digits(value)
    if loose == "address":
        form = F.when(value.rlike(rf"^{LOCAL}+@{HOST}+\.[a-z]{{2,}}$") | value.rlike(r"[(\[](?:at|dot)[)\]]"), 1).when(value.rlike(r"@\x20|\x20@|\.\x20|\x20\."), -1).otherwise(0)
        ending = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
        lists = F.when(ending.isin(*ENDINGS), 1).when(F.length(ending) == 2, 0).otherwise(-1)
        size = F.least(F.floor(F.length(value) / 12), F.lit(4))
    elif loose == "number":
        grouped = value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$") | value.rlike(r"^\(?[0-9]{3}\)?[\x20.-]\x20?[0-9]{3}[\x20.-][0-9]{4}$")
        form = F.when(grouped | (F.length(d).between(13, 15) & luhn(value)), 1).when(value.rlike(r"^[0-9]+$"), -1).otherwise(0)
        lists = F.when(F.greatest(*(F.substring(d, 1, k).isin(*[p for p in PREFIXES if len(p) == k]) for k in (2, 3, 4))), 1).otherwise(0)
        size = F.least(F.length(d), F.lit(20))
    elif loose == "name":
        form = F.when(value.rlike(r"\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+\x20\p{Lu}|\.\x20\p{Lu}\p{Ll}+\x20\p{Lu}"), 1).otherwise(0)
        lists = F.when(value.rlike(rf"\x20(?:{'|'.join(GIVEN)})(?:\x20|$)"), 1).otherwise(0)
        size = F.size(F.split(value, "\\x20"))
    elif loose == "street":
        form = F.when(value.rlike("^[0-9]{1,4}\\x20"), 1).otherwise(0)
        lists = F.when(value.rlike(rf"\x20(?:{'|'.join(STREETS[:7])})$") | value.rlike("(?:straße|strasse|platz|gasse)\\x20"), 1).otherwise(0)
        size = F.size(F.split(value, "\\x20"))
    else:
        form = F.when(account_check(value), 1).otherwise(-1)
        lists = F.when(F.substring(value, 1, 2).isin(*COUNTRIES), 1).otherwise(-1)
        size = F.floor(F.length(F.regexp_replace(value, "\\x20", "")) / 4)
    return {"form": form, "lists": lists, "context": context, "size": size.cast("int")}


def worth(text: Column) -> dict[str, Column]:
    """What a text with matches of a loose pattern is sure to have; plain searches, which cost less than patterns."""
    holds = lambda *words: F.greatest(*(F.contains(text, F.lit(w)) for w in words))
    digit = text.rlike("[0-9]")
    return {"address": holds("@", "at)", "at]"), "number": digit, "name": holds(*TITLES), "street": digit, "account": digit}


def candidates(text: Column, loose: str, cut: Column, may: Column) -> Column:
    """Loose matches with votes and features; cut: the pieces of the text as it was; may: whether there can be any."""
    before = lambda m: F.lower(part(cut, F.greatest(m["start"] - AROUND, F.lit(0)), m["start"]))
    one = lambda m: let(before(m), lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(loose).alias("loose"), *(v.cast("int").alias(k) for k, v in votes(m, loose, b).items())))
    return F.transform(places(text, LOOSE[loose], may), one)


@dataclass(frozen=True)
class Classifier:
    """Log odds of a candidate: a start value and one for each feature's value, by loose pattern."""

    start: dict[str, float]
    odds: dict[tuple[str, str, int], float]
    reliability: dict[tuple[str, str], float]

    def column(self, c: Column) -> Column:
        if not self.start:
            return F.lit(-99.0)
        total = F.coalesce(*(F.when(c["loose"] == k, v) for k, v in self.start.items()), F.lit(-99.0))
        for f in ("form", "lists", "context", "size"):
            parts = [F.when((c["loose"] == k) & (c[f] == v), odds) for (k, name, v), odds in self.odds.items() if name == f]
            total = total + F.coalesce(*parts, F.lit(0.0))
        return total


LABELERS = ("form", "lists", "context")


def expectation_maximisation(rows: list[tuple], rounds: int = 50) -> tuple[list[float], dict]:
    """Likelihood of each vote pattern to be personal data, and the labelers' reliabilities.

    rows: (loose, form, lists, context, size, count). Votes are taken as
    independent given the truth; each labeler has, for either truth, chances of
    its three votes, begun from the assumption that a vote is right more often
    than not.
    """
    loose = sorted({r[0] for r in rows})
    prior = {k: 0.5 for k in loose}
    chance = {(k, f, truth, v): (0.6 if v == (1 if truth else -1) else 0.15 if v else 0.25) for k in loose for f in LABELERS for truth in (0, 1) for v in (-1, 0, 1)}
    like = [0.5] * len(rows)
    for _ in range(rounds):
        for i, (k, *v, _, _) in enumerate(rows):
            a, b = math.log(prior[k]), math.log(1 - prior[k])
            for f, x in zip(LABELERS, v, strict=True):
                a += math.log(chance[k, f, 1, x])
                b += math.log(chance[k, f, 0, x])
            like[i] = 1 / (1 + math.exp(min(700.0, b - a)))
        for k in loose:
            mine = [(r, p) for r, p in zip(rows, like, strict=True) if r[0] == k]
            n = sum(r[5] for r, _ in mine)
            yes = sum(r[5] * p for r, p in mine)
            prior[k] = min(0.99, max(0.01, (yes + 1) / (n + 2)))
            for j, f in enumerate(LABELERS):
                for truth, total in ((1, yes), (0, n - yes)):
                    for v in (-1, 0, 1):
                        got = sum(r[5] * (p if truth else 1 - p) for r, p in mine if r[1 + j] == v)
                        start = 0.6 if v == (1 if truth else -1) else 0.15 if v else 0.25
                        chance[k, f, truth, v] = (got + 20 * start) / (total + 20)  # the start stays as a prior of 20 votes
    return like, {(k, f): chance[k, f, 1, 1] / (chance[k, f, 1, 1] + chance[k, f, 0, 1]) for k in loose for f in LABELERS}


def classifier(rows: list[tuple]) -> Classifier:
    """Naive Bayes over the candidates' features, with the likelihoods as soft labels."""
    like, reliability = expectation_maximisation(rows)
    start, odds = {}, {}
    for k in sorted({r[0] for r in rows}):
        mine = [(r, p) for r, p in zip(rows, like, strict=True) if r[0] == k]
        yes, no = sum(r[5] * p for r, p in mine) + 1, sum(r[5] * (1 - p) for r, p in mine) + 1
        start[k] = math.log(yes / no)
        for j, f in enumerate(("form", "lists", "context", "size")):
            values = sorted({r[1 + j] for r, _ in mine})
            for v in values:
                a = sum(r[5] * p for r, p in mine if r[1 + j] == v)
                b = sum(r[5] * (1 - p) for r, p in mine if r[1 + j] == v)
                odds[k, f, v] = math.log(((a + 1) / (yes + len(values))) / ((b + 1) / (no + len(values))))
    return Classifier(start, odds, reliability)


ACCEPT = math.log(0.8 / 0.2)


def found(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with `_email`, `_ip`, `_card`, `_phone` (fixed matches) and `_candidates`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = df.withColumns({f"_{k}": v for k, v in fixed_kinds(text).items()})
    base = F.concat(*(F.transform(f"_{k}", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for k in KINDS))
    # what the fixed spans cover is blanked out: candidates end before it and begin behind it
    left = F.when(F.size("_base") > 0, replaced(text, F.col("_base"), lambda s, n, new: F.repeat(F.lit("\0"), n))).otherwise(text)
    d = d.withColumn("_base", base).withColumn("_left", left).withColumns({f"_may_{k}": v for k, v in worth(F.col("_left")).items()})
    any_ = F.greatest(*(F.col(f"_may_{k}") for k in LOOSE))
    d = d.withColumn("_cut", F.when(any_, pieces(text)).otherwise(empty("array<string>")))
    d = d.withColumn("_candidates", F.concat(*(candidates(F.col("_left"), k, F.col("_cut"), F.col(f"_may_{k}")) for k in LOOSE)))
    return d.drop("_base", "_left", "_cut", *(f"_may_{k}" for k in LOOSE))


def learned(d: DataFrame) -> Classifier:
    """The classifier trained on all candidates of a table made by found(), once that is stored.

    Of a table not stored the optimizer would look for arrays that are not
    empty before all else, and make every column below again for that.
    """
    c = d.select(F.explode("_candidates").alias("c")).groupBy("c.loose", "c.form", "c.lists", "c.context", "c.size").count()
    return classifier(sorted(tuple(r) for r in c.collect()))  # 5 x 27 vote patterns x 21 sizes at most


def accepted(model: Classifier) -> Column:
    """Candidates that the classifier takes."""
    return F.filter("_candidates", lambda c: model.column(c) >= ACCEPT)


def kind_span(kind: str):
    """From a match to (kind, start, end)."""
    return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def all_spans(model: Classifier) -> Column:
    """Fixed spans by kind, then start; then the classifier's, by loose pattern and start."""
    named = [F.transform(f"_{k}", kind_span(k)) for k in KINDS]
    return F.concat(*named, F.transform(accepted(model), lambda c: F.struct(c["loose"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, email, ip, card, phone (arrays of start, end, value) and spans (kind, start, end).

    Null and empty texts have none. Rows that repeat all stay and get equal
    results; offsets are code points, ends exclusive. Without candidates (an
    empty table, too) nothing is learned and only the fixed kinds are found.
    Other columns of df, whatever their names, are not looked at.
    """
    d = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text"))
    d = stored(found(d).drop("text"), "pii")
    return d.withColumn("spans", all_spans(learned(d))).drop("_candidates").withColumnsRenamed({f"_{k}": k for k in KINDS})


def masked(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets; spans that touch are one, named by the first.

    Other columns stay as they are, whatever their names; null texts stay null,
    rows that repeat all stay, and an empty table gives none.
    """
    model = learned(stored(found(df.select(F.col(text_col).alias("text"))).select("_candidates"), "pii-candidates"))
    row = F.struct(*(df[f"`{c.replace('`', '``')}`"] for c in df.columns)).alias("row")
    f = found(df.select(row, F.col(text_col).cast("string").alias("text")))
    # of spans that begin together the longest comes first
    spans = F.transform(all_spans(model), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind")))
    f = f.select("row", "text", spans.alias("spans"))
    mark = lambda s, n, new: F.when(new, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    clean = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    f = f.select("row", clean.alias("clean"))
    return f.select(*(F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))
