"""Normalisers of money, dates, written amounts, serials, MICR lines, units and names: column expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import let

MONEY = "decimal(14,2)"
#: Cardinal words.
ONES = (
    "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN"
).split()
TENS = {"TWENTY": 20, "THIRTY": 30, "FORTY": 40, "FOURTY": 40, "FIFTY": 50, "SIXTY": 60, "SEVENTY": 70, "EIGHTY": 80, "NINETY": 90}
#: Months.
MONTHS = "january february march april may june july august september october november december".split()
#: Words that stand for nothing, in serials and in other fields.
NULL_SERIALS = ("NULL", "NONE", "N/A", "NA")
NULL_WORDS = ("NULL", "NONE", "N/A", "NA", "PURCHASER", "ADDRESS", "REMITTER")
#: Boilerplate in place of a payee.
NO_PAYEE = ("PAY TO THE ORDER OF", "FOR DEPOSIT ONLY", "ADDRESS", "PURCHASER")
#: Banks by pattern, in order.
BANKS = (
    (r"J\s*P\s*MORGAN|JPMORGAN|JP\s*MORGAN|CHASE", "JPMorgan Chase Bank"),
    (r"WELLS\s+FARGO", "Wells Fargo Bank"),
    (r"REGIONS", "Regions Bank"),
    (r"BANK\s+OF\s+TEXAS", "Bank of Texas"),
    (r"MORGAN\s+CHASE", "JPMorgan Chase Bank"),
    (r"IMPERIAL\s+CHASE", "Imperial Chase"),
)
#: Issuers by pattern, in order, with their agents.
ISSUERS = (
    ("Western Union", r"WESTERN\s+UNION|\bWALMART\b|\bKROGER\b|\bH[-\s]?E[-\s]?B\b|\bCVS\b", None),
    ("MoneyGram", r"MONEY\s*GRAM|MONEYGRAM|CITIZENS\s+ALLIANCE", None),
    ("Intermex", r"INTERMEX", "Intermex Wire Transfer LLC"),
    ("Fidelity Express", r"FIDELITY\s+EXPRESS", "Fidelity Express"),
    ("DolEx", r"BARRI|DOLEX", "Bank of Texas"),
    ("PLS", r"\bPLS\b|BANCFIRST", "BancFirst"),
    ("JPMorgan Chase", r"JPMORGAN|JP\s*MORGAN|CHASE", None),
    ("Wells Fargo", r"WELLS\s+FARGO", None),
    ("Prosperity Bank", r"PROSPERITY\s+BANK", None),
    ("Comerica Bank", r"COMERICA", None),
)


def empty_to_null(c: Column) -> Column:
    return let(c, lambda x: F.when(x != "", x))


def part(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def every(c: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")


def compact(c: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def stripped(c: Column, more: str = "") -> Column:
    """Without white space, and the characters of ``more``, at both ends."""
    own = r"[\s" + more + "]"
    return F.regexp_replace(c, f"^{own}+|{own}+$", "")


def plain(c: Column) -> Column:
    """Curly quotes as straight ones, runs of blanks and tabs as one blank."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "’‘", "''"), r"[ \t]{2,}|\t", " ")


def money(c: Column) -> Column:
    """An amount out of text: "356 56" and "356,56" have cents if the text is amount-like; 0 to 1,000,000, else null."""
    return let(F.regexp_replace(stripped(c), r"(?i)NOT\s+VALID\s+OVER\s*\$?\s*[\d,.]+", ""), _money)


def _money(s: Column) -> Column:
    like = s.rlike(r"(?i)\$|DOLLARS?|CENTS?|PAY\s+EXACTLY|PAY\s+ONLY|AMOUNT")

    def with_cents(between: str) -> tuple[Column, Column]:
        pattern = rf"(?:\$\s*)?\b([0-9]{{1,5}}){between}([0-9]{{2}})\b"
        fits = s.rlike(pattern) & (like | s.rlike(rf"^\s*[0-9]{{1,5}}{between}[0-9]{{2}}\s*$"))
        return fits, F.concat_ws(".", F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 2)).try_cast(MONEY)

    spaced, comma = with_cents(r"\s+"), with_cents(",")
    number = r"[-+]?\$?\s*((?:[0-9]{1,3}(?:,[0-9]{3})+)|[0-9]+)(?:[.](\d{1,2}))?"
    whole, cents = F.regexp_replace(F.regexp_extract(s, number, 1), ",", ""), F.rpad(F.regexp_extract(s, number, 2), 2, "0")
    value = F.concat_ws(".", whole, cents).try_cast(MONEY)
    return F.when(spaced[0], spaced[1]).when(comma[0], comma[1]).when(s.rlike(number), let(value, lambda v: F.when(v <= 1_000_000, v)))


def numeric_strip(c: Column) -> Column:
    """Digits and dots only, as a number; null if that is none."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("decimal(18,4)")


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_date(text, "yyyy-MM-dd")


def date(c: Column) -> Column:
    """A date out of text: ISO; month first, then day first; the code D mmddyy; month names. Letters read for digits are mended."""
    return let(stripped(c), lambda raw: let(F.translate(raw, "OoIl", "0011"), lambda s: _date_in(raw, s)))


def _date_in(raw: Column, s: Column) -> Column:
    iso = r"\b(20\d{2})[-/](\d{1,2})[-/](\d{1,2})\b"
    slashed = r"\b(\d{1,2})[./|\-](\d{1,2})[./|\-](\d{2,4})\b"
    code = r"(?i)\bD\s*(\d{2})(\d{2})(\d{2})\b"
    named = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(20\d{2})\b"
    g = lambda text, p, i: F.regexp_extract(text, p, i)
    year = let(g(s, slashed, 3), lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y))
    a, b = g(s, slashed, 1), g(s, slashed, 2)
    months = F.create_map(*(F.lit(x) for i, name in enumerate(MONTHS, 1) for n in dict.fromkeys((name, name[:3])) for x in (n, str(i))))
    month = F.try_element_at(months, F.lower(g(raw, named, 1)))
    return (
        F.when(s.rlike(iso), _date(g(s, iso, 1), g(s, iso, 2), g(s, iso, 3)))
        .when(s.rlike(slashed), F.coalesce(_date(year, a, b), _date(year, b, a)))
        .when(s.rlike(code), _date(F.concat(F.lit("20"), g(s, code, 3)), g(s, code, 1), g(s, code, 2)))
        .when(raw.rlike(named) & month.isNotNull(), _date(g(raw, named, 3), month, g(raw, named, 2)))
    )


def cardinal(c: Column) -> Column:
    """The number that English cardinal words make; null without any."""
    known = F.create_map(*(F.lit(x) for pair in [*((w, i) for i, w in enumerate(ONES)), *TENS.items()] for x in pair))
    tokens = F.split(F.regexp_replace(F.upper(c), "[^A-Z0-9 -]", " "), r"[\s-]+")
    tokens = F.transform(tokens, lambda w: F.struct(w.alias("word"), F.coalesce(F.try_element_at(known, w).cast("long"), w.try_cast("long")).alias("value")))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"), F.lit(False).alias("seen"))

    def step(acc: Column, token: Column) -> Column:
        word, value = token["word"], token["value"]
        hundred, thousand = word == "HUNDRED", word == "THOUSAND"
        most = F.greatest(acc["now"], F.lit(1).cast("long"))
        return F.struct(
            F.when(thousand, acc["total"] + most * 1000).otherwise(acc["total"]).alias("total"),
            F.when(thousand, F.lit(0).cast("long")).when(hundred, most * 100).otherwise(acc["now"] + F.coalesce(value, F.lit(0).cast("long"))).alias("now"),
            (acc["seen"] | hundred | thousand | value.isNotNull()).alias("seen"),
        )

    return F.aggregate(tokens, start, step, lambda out: F.when(out["seen"], out["total"] + out["now"]))


def amount_from_words(c: Column) -> Column:
    """A written amount with its cents, if any: over 0 and up to 100,000, else null."""
    over = lambda t: F.regexp_replace(F.regexp_replace(F.replace(t, F.lit("NO/100"), F.lit("00/100")), r"/\s*100(?:THS?|TH)?\b", "/100"), r"/\s*XX\b", "/100")
    t = let(F.upper(c), lambda t: F.when(t.contains("/"), over(t)).otherwise(t))
    t = F.trim(F.regexp_replace(t, "[^A-Z0-9/.'-]+", " "))
    words = "|".join([*ONES, *(w for w in TENS if w != "FOURTY"), "HUNDRED", "THOUSAND"])
    lead = rf"^(.*?)(\b(?:{words})\b.*)$"
    unled = let(t, lambda t: F.when(t.rlike(r"\d"), F.when(F.regexp_extract(t, lead, 1).rlike(r"\d"), F.regexp_extract(t, lead, 2)).otherwise(t)).otherwise(t))
    return let(let(unled, _dollars_and_cents), _worded_total)


def _dollars_and_cents(t: Column) -> Column:
    """(cents, dollars) of a written amount, dollars as text."""
    over, dollars_after, cents_after = r"^(.*?)\b(\d{1,2})\s*/\s*100\b", r"^(.*?)\bAND\s+(\d{1,2})\s+DOLLARS?\b", r"^(.*?)\b(\d{1,2})\s+CENTS?\b"
    both, after_and = r"^(.*?)\bDOLLARS?\b\s*(?:AND\s+)?([A-Z -]+)$", r"^(.*?)\bAND\s+([A-Z -]+)$"
    bare = r"^(.*?)\b(?:AND\s+)?(\d{1,2})\s*$"
    pair = lambda cents, dollars: F.struct(cents.cast("long").alias("cents"), dollars.alias("dollars"))
    of = lambda text, p, cents, dollars: pair(F.regexp_extract(text, p, cents), F.regexp_extract(text, p, dollars))
    number = lambda w: F.when(stripped(w).rlike("^(?:NO|ZERO|00)$"), 0).otherwise(F.coalesce(cardinal(w), F.lit(0)))
    split = lambda head, p: pair(let(F.regexp_extract(head, p, 2), number), F.regexp_extract(head, p, 1))
    worded = lambda head: F.when(head.rlike(both), split(head, both)).when(head.rlike(after_and), split(head, after_and)).otherwise(pair(number(head), F.lit("")))
    is_bare = t.rlike(bare) & F.regexp_extract(t, bare, 1).rlike("[A-Z]")
    # plain searches first, as most texts lack most of the signs
    out = F.when(t.contains("/") & t.rlike(over), of(t, over, 2, 1)).when(t.contains("DOLLAR") & t.rlike(dollars_after), of(t, dollars_after, 2, 1))
    out = out.when(t.contains("CENT") & t.rlike(cents_after), of(t, cents_after, 2, 1))
    return out.when(t.contains("CENT") & t.rlike(r"\bCENTS?\b"), let(F.regexp_extract(t, r"^(.*?)\bCENTS?\b", 1), worded)).when(is_bare, of(t, bare, 2, 1)).otherwise(pair(F.lit(0), t))


def _worded_total(x: Column) -> Column:
    dollars = F.regexp_replace(x["dollars"], r"\bDOLLARS?\b.*$", "")
    dollars = F.regexp_replace(F.regexp_replace(dollars, r"\b(PAY|EXACTLY|ONLY|THE|SUM|OF|AMOUNT|PAYABLE)\b", " "), r"\bAND\s*$", " ")
    total = (cardinal(dollars) + x["cents"].cast("decimal(4,0)") / 100).cast(MONEY)
    return F.when(x["cents"].between(0, 99), let(total, lambda y: F.when((y > 0) & (y <= 100_000), y)))


def labelled_amount(c: Column) -> Column:
    """The first amount of 0.01 to 100,000 beside a label, by label patterns in order."""
    return let(F.regexp_replace(plain(c), r"(?i)NOT\s+VALID\s+OVER[^\n]*", ""), _labelled)


def _labelled(t: Column) -> Column:
    spaced, whole = r"([0-9]{1,5}\s+[0-9]{2})", r"([\d,]+(?:\.\d{1,2})?)"
    patterns = (
        r"(?i)PAY\s+EXACTLY[^$\n]{0,80}\$\s*" + spaced, r"(?i)PAY\s+ONLY[^$\n]{0,50}\$\s*" + spaced, r"\$\s*" + spaced + r"(?!\d)", r"\$\s*([0-9]{1,5},[0-9]{2})(?!\d)",
        r"(?i)PAY\s+EXACTLY[^$\n]{0,80}\$\s*" + whole, r"(?i)PAY\s+ONLY[^$\n]{0,50}\$\s*" + whole, r"\*+\s*\$?\s*([\d,]+\.\d{1,2})\s*\*+", r"\$\s*([\d,]+\.\d{1,2})",
    )
    first = lambda p: F.get(F.filter(F.transform(every(t, p), money), lambda x: x.between(0.01, 100_000)), 0)
    return F.coalesce(*map(first, patterns))


def routing_number(c: Column) -> Column:
    """Whether the digits are nine whose sum weighted 3, 7, 1 is a multiple of ten."""
    total = lambda d: sum((F.substring(d, i + 1, 1).try_cast("int") * w for i, w in enumerate((3, 7, 1) * 3)), F.lit(0))
    return let(digits(c), lambda d: (F.length(d) == 9) & F.coalesce(total(d) % 10 == 0, F.lit(False)))


def serial_in(c: Column) -> Column:
    """The first labelled, explicit or bare number of 5 to 12 digits in text; routing numbers and zeros don't count bare."""
    return let(F.upper(plain(c)), _serial_in)


def _serial_in(t: Column) -> Column:
    bare = F.filter(every(t, r"(\b\d{7,11}\b)"), lambda x: ~routing_number(x) & ~x.rlike("^0+$"))
    found = F.concat(
        every(t, r"(?:MONEY\s*ORDER|DOCUMENT|SERIAL|CHECK)\s*(?:NO|NUMBER|#)?\.?\s*[:#-]?\s*(\d{7,14})"), every(t, r"\b([12]\d[-\s]?\d{7,12})\b"),
        every(t, r"CHECK\s*NO\.?\s*[:#]?\s*(\d{6,12})"), every(t, r"SERIAL\s*[:#]?\s*(\d{5,12})"), bare,
    )
    return F.get(F.filter(F.transform(found, digits), lambda x: F.length(x).between(5, 12)), 0)


def serial(c: Column) -> Column:
    """Upper case, letters read for digits mended, symbols gone; masked ones are null, long numeric ones digits."""
    fixed = lambda s: F.regexp_replace(F.translate(s, "OIL", "011"), "[^0-9A-Z-]", "")
    told = lambda x: F.when(~x.rlike(r"^\d{2}-?X+$"), empty_to_null(F.when(x.rlike(r"^\d{2}-?\d{7,12}$"), digits(x)).otherwise(x)))
    whole = lambda c: let(F.upper(stripped(c)), lambda s: F.when(~s.isin(*NULL_SERIALS), let(fixed(s), told)))
    # most are digits only, and stay as they are
    return let(c, lambda c: F.when(c.rlike(r"\A[0-9]+\z"), c).otherwise(whole(c)))


def micr(c: Column) -> Column:
    """Routing number, check number and account candidates of a MICR line."""
    return let(every(c, r"(\d+)"), lambda groups: let(F.get(F.filter(groups, routing_number), 0), lambda routing: let(F.filter(groups, lambda x: ~x.eqNullSafe(routing)), lambda others: _micr(routing, others))))


def _micr(routing: Column, others: Column) -> Column:
    short = lambda x: F.length(F.ltrim(x, F.lit("0"))).between(2, 6)
    check = F.ltrim(F.try_element_at(F.filter(others, short), F.lit(-1)), F.lit("0"))
    return F.struct(routing.alias("routing_number"), check.alias("check_number"), F.array_join(F.filter(others, lambda x: ~short(x)), ",").alias("accounts"))


def micr_line(c: Column) -> Column:
    """The longest line of text with two groups of four digits or more and 14 digits in them; the first of equal ones."""
    groups = lambda line: every(F.regexp_replace(line, "[^0-9 ]", " "), r"(\d{4,})")
    joined = F.transform(F.split(c, r"\R"), lambda line: let(groups(line), lambda g: F.struct(F.size(g).alias("n"), F.array_join(g, " ").alias("text"))))
    fit = F.filter(joined, lambda x: (x["n"] >= 2) & (F.length(digits(x["text"])) >= 14))
    pick = lambda a, b: F.when(F.length(b["text"]) > F.length(F.coalesce(a, F.lit(""))), b["text"]).otherwise(a)
    return F.aggregate(fit, F.lit(None).cast("string"), pick)


def unit_in(*cs: Column) -> Column:
    """The apartment unit in joined columns, by patterns in order."""
    t = F.concat_ws("\n", *map(empty_to_null, cs))
    own = r"([A-Z]?\d{3,5}[A-Z]?)"
    patterns = (
        r"(?im)(?:APT|APARTMENT|UNIT|SUITE|STE|#)\s*\.?\s*#?\s*" + own + r"\b", r"(?im)\b(?:RENT|MEMO|FOR|ACCOUNT|ACCT)\D{0,20}" + own + r"\b", r"(?im)\b" + own + r"\s*$",
    )
    return let(t, lambda t: F.upper(F.coalesce(*(part(t, p) for p in patterns))))


def serial_from_account(c: Column) -> Column:
    """The serial in a report's account: after 40 without the check digit, else its last eleven digits."""
    long = lambda tail: F.when(F.length(tail) >= 12, tail.substr(F.lit(1), F.length(tail) - 1)).otherwise(tail)
    return let(digits(c), lambda d: F.when(d.startswith("40") & (F.length(d) >= 12), let(F.substring(d, 3, 1000), long)).when(F.length(d) >= 9, F.right(d, F.lit(11))))


def payee(c: Column) -> Column:
    """One line without unit; boilerplate is null."""
    return let(stripped(F.regexp_replace(c, r"\s+", " "), ".,-"), _payee)


def _payee(s: Column) -> Column:
    bare = F.regexp_replace(s, r"(?i)\s+(?:APT|APARTMENT|UNIT|#)\s*\.?\s*#?\s*[A-Z]?\d{3,5}[A-Z]?\s*$", "")
    bare = F.regexp_replace(bare, r"(?i)^#\s*[A-Z]?\d{3,5}[A-Z]?\s+", "")
    # upper case is slow to make, and few begin like boilerplate; other letters than A to Z may become such
    may = s.rlike("^[" + "".join(sorted({x for n in NO_PAYEE for x in n[0] + n[0].lower()})) + r"]|[^\x00-\x7f]")
    return F.when(~(may & F.upper(s).isin(*NO_PAYEE)), empty_to_null(stripped(bare, ".,-")))


def property_name(c: Column) -> Column:
    """A property's name, or null if it is noise: few words, mostly short ones, mixed case, a bank's name."""
    s = stripped(F.regexp_replace(c, r"\s+", " "), ":-")
    for tail in (r"\bAccount\s+Currency\b.*$", r"\bNumber\s+of\s+Deposits\b.*$", r"\bTotal\s+of\s+Deposits\b.*$"):
        s = F.regexp_replace(s, "(?i)" + tail, "")
    s = stripped(F.regexp_replace(s, r"/\s*\d{4,}\b.*$", ""), ":/-")
    short = lambda words: F.size(F.filter(words, lambda w: F.length(w) <= 3))
    mixed = lambda words: F.exists(words, lambda w: w.rlike("[a-z][A-Z]|[A-Z][a-z][A-Z]"))
    bad = lambda s, words: (F.size(words) < 2) | (short(words) > F.size(words) * 0.65) | mixed(words) | s.rlike(r"(?i)^[A-Z]{1,4}\d{1,5}\s*\(COPY\)$")
    return let(s, lambda s: F.when(~let(every(s, "([A-Za-z]+)"), lambda words: bad(s, words)), s))


def property_aliases(c: Column) -> Column:
    """Names to match payees with: the whole, what follows d/b/a, without suffix, before in and at, first words; each once."""
    dba = part(c, r"(?i)\b(?:d\s*/?\s*b\s*/?\s*a|dba)\b\s+(.+)$")
    whole = lambda base: F.coalesce(property_name(base), base)
    return F.when(c.isNotNull() & (c != ""), let(dba, lambda dba: let(let(F.coalesce(dba, c), whole), lambda base: _aliases(c, dba, base))))


def _aliases(c: Column, dba: Column, base: Column) -> Column:
    words = every(base, "([A-Za-z0-9]+)")
    named = [
        c, dba, F.regexp_replace(base, r"(?i)\b(APARTMENTS?|APTS?|VILLAGE|LP|LLC|LTD|LIMITED\s+PARTNERSHIP)\b", ""),
        *(F.when(F.lower(base).contains(sep), F.regexp_extract(base, f"(?i)^(.*?){sep}", 1)) for sep in (" in ", " at ", " dba ")),
        let(words, lambda words: F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " "))),
    ]
    # each name with the letters and digits it is told by
    clean = F.transform(F.array_compact(F.transform(F.array(*named), property_name)), lambda x: F.struct(x.alias("name"), compact(x).alias("key")))
    add = lambda seen, x: F.when(F.exists(seen, lambda y: y["key"] == x["key"]), seen).otherwise(F.concat(seen, F.array(x)))
    return F.aggregate(clean, F.array().cast("array<struct<name:string,key:string>>"), add, lambda seen: F.transform(seen, lambda x: x["name"]))


def bank_name(c: Column) -> Column:
    """The first bank whose pattern fits, else the trimmed value."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(BANKS):
        out = F.when(c.rlike("(?i)" + pattern), F.lit(name)).otherwise(out)
    return F.coalesce(out, stripped(c))


def valid_bank_name(c: Column) -> Column:
    """The bank's name if it has two words and three letters beside generic ones."""
    name = bank_name(c)
    own = lambda words: F.filter(words, lambda w: ~F.upper(w).isin("NAME", "ACCOUNT", "DEPOSIT", "FINANCIAL", "INSTITUTION", "BANK"))
    fits = lambda words: (F.size(words) >= 2) & (F.length(F.array_join(own(words), "")) >= 3)
    return let(name, lambda name: F.when(let(every(name, "([A-Za-z]+)"), fits), name))


def issuer(c: Column) -> Column:
    """(issuer, agent) of the first issuer whose pattern fits."""
    one = lambda own, by: F.struct(F.lit(own).cast("string").alias("issuer"), F.lit(by).cast("string").alias("agent"))

    def first(c: Column) -> Column:
        out = one(None, None)
        for own, pattern, by in reversed(ISSUERS):
            out = F.when(c.rlike("(?i)" + pattern), one(own, by)).otherwise(out)
        return out

    return let(c, first)


def instrument_type(kind: Column, text: Column) -> Column:
    """One of four types: the given one if it is one, else by the text's words."""
    told = lambda t: F.when(t.contains("CASHIER") | t.contains("OFFICIAL CHECK"), "CashiersCheck").when(t.contains("CHECK") & ~t.contains("MONEY"), "Check").otherwise("MoneyOrder")
    read = let(F.upper(F.coalesce(text, F.lit(""))), told)
    return F.when(kind.isNull() | (kind == ""), read).when(kind.isin("MoneyOrder", "Check", "CashiersCheck", "Escrow"), kind).otherwise("MoneyOrder")


def payment_description(given: Column, kind: Column) -> Column:
    return F.coalesce(empty_to_null(given), F.when(kind == "Escrow", "Escrow Deposit Paid In").when(kind.isin("Check", "CashiersCheck"), "Payment-Check").otherwise("Payment-MoneyOrder"))


def canonical_angle(c: Column) -> Column:
    """0, 90, 180 or 270 if the angle is within ten degrees of it, else the angle in 0 to 360."""
    turned = F.pmod(F.bround(c), F.lit(360.0))
    out = turned
    for right in (0, 90, 180, 270):
        away = F.abs(turned - right)
        out = F.when(F.least(away, 360 - away) <= 10, F.lit(float(right))).otherwise(out)
    return out
