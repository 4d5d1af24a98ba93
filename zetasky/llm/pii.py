"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose candidate spans. Three labelers vote yes or no on each or abstain: a strict form check, a gazetteer,
and the words just before it. A span classifier, logistic in what the labelers do not look at (the span's digits and
the characters around it), and the labelers' reliabilities are estimated together by expectation-maximisation over
the counts of candidates that look alike: the classifier is the prior of a candidate's truth, the votes are its
evidence, and each round fits both to the beliefs of the last. Candidates beyond the base forms stay where they are
believed in the end. Base spans always stay.

Only those counts come to the driver: a row for each kind, vote pattern and feature pattern, 6048 at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import stash

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("national_phone", "ssn", "iban")
KINDS = BASE_KINDS + ADDED_KINDS

# The forms looked for. A match may only start where its run starts or where the last match ended,
# and runs are possessive: neither changes a match, and both keep long runs linear and off the stack.
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "national_phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
}
#: A text without this string cannot match, which is far cheaper to see than a pattern.
NEEDED = {"email": "@", "ip": ".", "phone": "+", "national_phone": "", "ssn": "-", "iban": "", "card": ""}
# Top-level domains, telephone country codes, lengths of account numbers by country.
DOMAINS = "at au be biz br ca ch cn co com cz de dk edu es eu fi fr gov gr hu ie in info int io it jp kr lu me mil mx name net nl no nz org pl pro pt ro ru se sg sk tr tv tw ua uk us za"
CALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 7 81 82 84 86 90 91 92 93 94 95 98 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 387 389 420 421 423 852 853 855 880 886 961 962 963 964 965 966 968 971 972 973 974 977"
ACCOUNTS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
#: What a gazetteer knows of a candidate: a domain, a public network, an issuer, a country, an area.
GAZETTEERS = {
    "email": rf"(?i)\.(?:{DOMAINS.replace(' ', '|')})$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|2[4-5][0-9]\.)",
    "card": r"^(?:4|5 ?-?[1-5]|2 ?-?[2-7]|3 ?-?[47]|6 ?-?0 ?-?1 ?-?1|6 ?-?5)",
    "phone": rf"^\+(?:{CALLING.replace(' ', '|')})",
    "national_phone": r"^\(?[2-9](?!11)[0-8][0-9]",
    "ssn": r"^(?!000|666|9)",
    "iban": rf"^(?:{'|'.join(f'{c}.{{{n - 2}}}' for c, n in ACCOUNTS.items())})$",
}
# Words that announce a kind, and words that announce numbers of other kinds.
CONTEXTS = {
    "email": r"(?i)(?:mail|contact|write|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|address|server|client)",
    "card": r"(?i)(?:card|visa|credit|pay|karte|tarjeta|carte)",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|handy)",
    "national_phone": r"(?i)(?:phone|tel|call|mobile|fax|handy)",
    "ssn": r"(?i)(?:ssn|social|security)",
    "iban": r"(?i)(?:iban|account|konto|cuenta|compte|bank)",
}
DENIALS = r"(?i)(?:order|invoice|part|version|release|isbn|serial|sku|model|page|room|lot|bestell|rechnung|pedido|factura|commande|facture)"
#: Features of the classifier, as patterns of the span, of what stands before it and of what follows.
FEATURES = (
    ("match", r"([0-9])\1{3}"),
    ("match", r"0123|1234|2345|3456|4567|5678|6789|9876|8765|7654"),
    ("before", r"[:=#] ?$"),
    ("before", r"[A-Za-z0-9_/]$"),
    ("after", r"^[A-Za-z0-9_/]"),
)
CONTEXT_CHARS = 32
#: Matches of a text whose positions are added up together: the steps of a text with n matches are n * CHUNK and (n / CHUNK)^2 at most.
CHUNK = 256
#: Characters of a block of a text that is masked.
MASK_BLOCK = 4096
ABSTAINS, NO, YES = 0, 1, 2
LABELERS = 3


def luhn(number: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    backwards = F.reverse(number)
    value = lambda i: F.substring(backwards, i, F.lit(1)).try_cast("int")
    part = lambda i: F.when(i % 2 == 1, value(i)).otherwise(value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda total, i: total + part(i)) % 10 == 0


def strict(kind: str, match: Column) -> Column:
    """The form check of a kind; for base kinds it is what the contract asks."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p).try_cast("int") <= 255)))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "national_phone":
        return F.substring(digits, 4, 1) >= "2"
    if kind == "ssn":
        return (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    if kind == "iban":
        return F.length(match) >= 15
    return F.lit(True)


def located(texts: DataFrame) -> DataFrame:
    """``texts`` with a column c_kind for each kind: its candidates as (start, end, match, before, after), leftmost and
    non-overlapping, in code points.

    Splitting at a pattern gives the gaps between its matches; gaps and matches by turns add up to positions, first
    within chunks of them, then from chunk to chunk. What stands before and after a match comes from the gaps too, so no
    step reads the text again.
    """
    names = dict.fromkeys(texts.columns)
    sought = {k: F.when(F.contains("text", F.lit(NEEDED[k])), F.col("text")).otherwise(F.lit("")) if NEEDED[k] else F.col("text") for k in KINDS}
    parts = texts.select(*names, *(F.split(sought[k], PATTERNS[k], -1).alias(f"gaps_{k}") for k in KINDS), *(F.regexp_extract_all(sought[k], F.lit(PATTERNS[k]), F.lit(0)).alias(f"matches_{k}") for k in KINDS))
    zipped = parts.select(*names, *(F.arrays_zip(F.col(f"gaps_{k}").alias("gap"), F.col(f"matches_{k}").alias("match"), F.slice(f"gaps_{k}", 2, F.size(f"gaps_{k}")).alias("after")).alias(f"pairs_{k}") for k in KINDS))
    kind_of = "struct<start:int,end:int,match:string,before:string,after:string>"

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("match"), F.right(pair["gap"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(pair["after"], F.lit(1)).alias("after"))
        return F.struct(end.alias("at"), F.concat(done["found"], F.array(span)).alias("found"))

    def chunks(k: str) -> Column:
        pairs = F.col(f"pairs_{k}")
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind_of}>").alias("found"))
        walk = lambda i: F.aggregate(F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)), start, step)
        # The gap after the last match is a pair of its own, without a match.
        return F.when(F.size(pairs) > 1, F.transform(F.sequence(F.lit(0), ((F.size(pairs) - 1) / CHUNK).cast("int")), walk)).otherwise(F.array().cast(f"array<struct<at:int,found:array<{kind_of}>>>"))

    walked = zipped.select(*names, *(chunks(k).alias(f"chunks_{k}") for k in KINDS))

    def shifted(k: str) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.col(f"chunks_{k}"), none, lambda done, c: F.struct((done["at"] + c["at"]).alias("at"), F.concat(done["starts"], F.array(done["at"])).alias("starts")))["starts"]
        move = lambda c, at: F.transform(c["found"], lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at))
        return F.filter(F.flatten(F.zip_with(f"chunks_{k}", starts, move)), lambda s: s["match"].isNotNull())

    return walked.select(*names, *(shifted(k).alias(f"c_{k}") for k in KINDS))


def voted(kind: str) -> Column:
    """Candidates as (start, end, kind number, votes, features): a base-3 digit for each labeler, a bit for each feature."""

    def vote(s: Column) -> Column:
        form = F.when(strict(kind, s["match"]), YES).otherwise(NO)
        gazetteer = F.when(F.rlike(s["match"], F.lit(GAZETTEERS[kind])), YES).otherwise(NO)
        context = F.when(F.rlike(s["before"], F.lit(CONTEXTS[kind])), YES).when(F.rlike(s["before"], F.lit(DENIALS)), NO).otherwise(ABSTAINS)
        features = sum((F.rlike(s[part], F.lit(pattern)).cast("int") * 2**i for i, (part, pattern) in enumerate(FEATURES)), F.lit(0))
        return F.struct(s["start"], s["end"], F.lit(KINDS.index(kind)).alias("kind"), (form + 3 * gazetteer + 9 * context).alias("votes"), features.alias("features"))

    return F.transform(F.col(f"c_{kind}"), vote)


@dataclass
class SpanClassifier:
    """Log odds that a candidate is personal data: a weight for each kind and feature, and one for each labeler's vote."""

    bias: list[float]
    weights: list[float]
    evidence: list[list[float]]

    def odds(self, kind, votes, features, pick=lambda table, i: np.asarray(table)[i], floor=np.floor):
        out = pick(self.bias, kind)
        for i, w in enumerate(self.weights):
            out = out + floor(features / 2**i) % 2 * w
        for i, table in enumerate(self.evidence):
            out = out + pick(table, (floor(votes / 3**i) % 3))
        return out

    def score(self, kind: Column, votes: Column, features: Column) -> Column:
        return self.odds(kind, votes, features, lambda table, i: F.element_at(F.array(*map(F.lit, table)), i.cast("int") + 1), F.floor)


def fit(counts: dict[tuple[int, int, int], int], rounds: int = 60) -> SpanClassifier:
    """The classifier and the labelers' reliabilities by expectation-maximisation from counts of (kind, votes, features).

    Starts from the majority of votes. Each round weighs every labeler's yes, no and silence by how often beliefs saw
    it on true and on other spans, and climbs the classifier's likelihood; ridge and pseudo-counts keep both finite.
    """
    model = SpanClassifier([0.0] * len(KINDS), [0.0] * len(FEATURES), [[0.0] * 3 for _ in range(LABELERS)])
    if not counts:
        return model
    kind, votes, features = (np.array(c) for c in zip(*counts, strict=True))
    n = np.array(list(counts.values()), dtype=np.float64)
    cast = np.stack([votes // 3**i % 3 for i in range(LABELERS)])
    lead = (cast == YES).sum(axis=0) - (cast == NO).sum(axis=0)
    belief = np.where(lead > 0, 0.9, np.where(lead < 0, 0.1, 0.5))
    x = np.concatenate([np.eye(len(KINDS))[kind], (features[:, None] >> np.arange(len(FEATURES))) & 1], axis=1).astype(np.float64)
    theta = np.zeros(x.shape[1])
    for _ in range(rounds):
        evidence = []
        for i in range(LABELERS):
            seen = [np.bincount(cast[i], weights=n * b, minlength=3) + s for b, s in ((belief, (1.0, 0.5, 1.5)), (1 - belief, (1.0, 1.5, 0.5)))]
            evidence.append(np.log(seen[0] / seen[0].sum()) - np.log(seen[1] / seen[1].sum()))
        for _ in range(3):  # Newton's steps; the ridge is a pseudo-count of one for each weight
            chance = 1 / (1 + np.exp(-(x @ theta)))
            slope = x.T @ (n * (belief - chance)) - theta
            theta = theta + np.linalg.solve((x * (n * chance * (1 - chance))[:, None]).T @ x + np.eye(len(theta)), slope)
            theta = np.clip(theta, -12, 12)
        model = SpanClassifier(theta[: len(KINDS)].tolist(), theta[len(KINDS) :].tolist(), [e.tolist() for e in evidence])
        belief = 1 / (1 + np.exp(-np.clip(model.odds(kind, votes, features, lambda t, i: np.array(t)[i.astype(int)]), -30, 30)))
    return model


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ordered(spans: Column) -> Column:
    return F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))


def find_personal_data(docs: DataFrame, keep: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """Find personal data in every whole text.

    ``docs`` needs doc_id, text and the columns named in ``keep``; other columns are ignored. Returns doc_id,
    n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans (kind:start:end, code points, by start), span_list
    (the same as structs) and, with ``keep``, those columns in a struct ``kept``. A null or empty text has no spans;
    rows with equal or null ids are kept each; an empty table gives no rows. No shuffle but of the counts; the spans
    found in the one pass over the texts are written to the shared folder, so the classifier's pass does not search
    again. Base candidates that fail their form check only teach the labelers' reliabilities. The time of a text grows
    with its length and its matches; only whether an added candidate crosses a base span is looked at pair by pair.
    """
    kept = [F.struct(*(F.col(f"`{c}`") for c in keep)).alias("kept")] if keep else []
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *kept)
    kept = ["kept"] * len(kept)
    sought = located(texts).select("doc_id", *kept, *(voted(k).alias(f"v_{k}") for k in KINDS))
    seen = F.flatten(F.array(*(F.col(f"v_{k}") for k in BASE_KINDS)))
    more = F.flatten(F.array(*(F.col(f"v_{k}") for k in ADDED_KINDS)))
    fits = lambda s: s["votes"] % 3 == YES
    found = sought.select("doc_id", *kept, seen.alias("seen"), more.alias("more")).select("doc_id", *kept, F.filter("seen", fits).alias("base"), F.filter("seen", lambda s: ~fits(s)).alias("failed"), "more")
    found = found.withColumn("more", F.filter("more", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))))
    found, _ = stash(found)
    counts = found.select(F.explode(F.concat("base", "failed", "more")).alias("s")).groupBy("s.kind", "s.votes", "s.features").count().collect()
    classifier = fit({(r["kind"], r["votes"], r["features"]): r["count"] for r in counts})
    level = float(np.log(threshold / (1 - threshold)))
    chosen = F.filter("more", lambda s: classifier.score(s["kind"], s["votes"], s["features"]) >= level)
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.withColumn("added", chosen).select(
        "doc_id",
        *(number(k) for k in BASE_KINDS),
        F.size("added").cast("long").alias("n_added"),
        F.sha2(joined(ordered(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        joined(ordered(F.concat("base", "added"))).alias("spans"),
        ordered(F.concat("base", "added")).alias("span_list"),
        *kept,
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become the first one's kind.

    The text is cut into blocks once, so that a piece is counted off from its block's start and not from the text's.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def clear(done: Column, s: Column) -> Column:
        stays = s["start"] >= done["at"]
        piece = F.struct(done["at"].alias("begin"), s["start"].alias("end"), s["kind"].alias("kind"))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(stays, F.concat(done["pieces"], F.array(piece))).otherwise(done["pieces"]).alias("pieces"))

    def between(blocks: Column, begin: Column, end: Column) -> Column:
        first, last = (F.floor(at / MASK_BLOCK).cast("int") for at in (begin, end))
        inner = F.array_join(F.slice(blocks, first + 2, last - first - 1), "")
        head, tail = F.coalesce(F.get(blocks, first), F.lit("")), F.coalesce(F.get(blocks, last), F.lit(""))
        within = F.substring(head, begin % MASK_BLOCK + 1, end - begin)
        return F.when(first == last, within).otherwise(F.concat(F.substring(head, begin % MASK_BLOCK + 1, F.lit(MASK_BLOCK)), inner, F.substring(tail, F.lit(1), end % MASK_BLOCK)))

    def let(value: Column, use) -> Column:
        """``use`` of a value that is evaluated once."""
        return F.transform(F.array(value), use)[0]

    def pieces(chunks: Column) -> Column:
        none = F.array().cast("array<struct<begin:int,end:int,kind:int>>")
        ends = F.transform(chunks, lambda c: F.array_max(F.transform(c, lambda s: s["end"])))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("reached"))
        reached = F.aggregate(ends, start, lambda done, end: F.struct(F.greatest(done["at"], end).alias("at"), F.concat(done["reached"], F.array(done["at"])).alias("reached")))["reached"]
        return F.flatten(F.zip_with(chunks, reached, lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("pieces")), clear)["pieces"]))

    def put_together(blocks: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), ((F.size(spans) - 1) / CHUNK).cast("int")), lambda i: F.slice(spans, i * CHUNK + 1, F.lit(CHUNK)))
        replaced = F.transform(let(chunks, pieces), lambda p: F.concat(between(blocks, p["begin"], p["end"]), F.element_at(names, p["kind"] + 1)))
        return F.concat(F.array_join(replaced, ""), between(blocks, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{MASK_BLOCK}}}+"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, put_together))
