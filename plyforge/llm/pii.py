"""Personal data to format-preserving pseudonyms, in DataFrame expressions only.

Validated values are replaced by a keyed permutation of their own format, so equal values stay equal across documents and
other values stay apart: an alternating Feistel network over Z_a x Z_b adds, round by round, a keyed SHA-256 of one half
to the other. Where the format's valid values don't fill a power of ten, a * b is their exact number, so no value leaves
the format and no cycle is walked: 146097 = 189 * 773 days of 1800-01-01 to 2199-12-31, 2^16 * 2^16 addresses,
88902 * 9999 social security numbers. Card and IBAN check digits are computed anew. Mail addresses and secrets, which are
no numbers, get keyed names of the same shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

_NOT_IN_WORD = r"(?<![A-Za-z0-9])"
_END = r"(?![A-Za-z0-9])"
#: Java's matcher goes one call deeper with every round of a group, so every group has a bound: a domain has 253 characters.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?){0,125}\.[A-Za-z]{2,63}+"
SECRET = r"(?<![A-Za-z])(?i:token|secret|api[_-]?key|passwd|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}+"
IBAN = _NOT_IN_WORD + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP = rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[A-Za-z0-9])"
_YEAR, _LEAP = "(?:1[89]|2[01])[0-9]{2}", "(?:(?:1[89]|2[01])(?:0[48]|[2468][048]|[13579][26])|2000)"
_ISO = f"{_YEAR}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1[0-9]|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)|{_LEAP}-02-29"


def _short_dates(sep: str, day_first: bool) -> str:
    """Days of the calendar with one or two digits for day and month."""
    common = [("(?:0?[1-9]|1[0-9]|2[0-8])", "(?:0?[1-9]|1[0-2])"), ("(?:29|30)", "(?:0?[13-9]|1[0-2])"), ("31", "(?:0?[13578]|1[02])")]
    every = [(d, m, _YEAR) for d, m in common] + [("29", "0?2", _LEAP)]
    return "|".join(f"{d if day_first else m}{sep}{m if day_first else d}{sep}{y}" for d, m, y in every)


#: Behind an ISO date a time may follow after a T.
DATE = (
    rf"(?<![A-Za-z0-9./-])(?:(?:{_ISO})(?=T[0-9]{{2}}(?::?[0-9]{{2}}|Z)|(?![A-Za-z0-9]))"
    rf"|(?:{_short_dates('[.]', True)}|{_short_dates('/', True)}|{_short_dates('/', False)})(?![A-Za-z0-9]))(?![./-][0-9])"
)
SSN = r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9]|-[0-9])"
#: Java's look behind has no repeated groups, so they are written out.
_EIGHT_TO_15 = r"(?<=\+[0-9]" + "[ .-]?[0-9]" * 7 + "[ .-]?[0-9]?" * 7 + ")"
PHONE = r"(?<![A-Za-z0-9+(])(?:(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?:\+?[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}" + _EIGHT_TO_15 + r")(?![A-Za-z0-9]|[.-][0-9])"
CARD = _NOT_IN_WORD + r"[0-9](?:[ -]?[0-9]){12,18}" + _END
#: Lengths that the IBANs of a country have.
IBAN_LENGTHS = {
    n: c.split()
    for n, c in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
#: In order: the first with a valid value at a place takes it, with its longest one; of IBANs, the length of the country first.
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "ip": IP, "date": DATE, "ssn": SSN, "card": CARD, "phone": PHONE}


@dataclass(frozen=True)
class PiiParams:
    """key: the secret of the permutation; the same key keeps values linked between runs. month_first: how 3/4/2001 is read."""

    key: str
    month_first: bool = True


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(left: str, right: str, a: str, b: str, kind: str, key: str, inverse: bool = False) -> str:
    """SQL of struct<l, r> with (l, r) permuted over Z_a x Z_b; left, right, a, b: SQL of BIGINT below 2^62."""

    def f(half: str) -> str:
        return f"cast(conv(substring(sha2(concat({_q(key + '|' + kind + '|')}, i, '|', {half}), 256), 1, 15), 16, 10) as bigint)"

    sign = "-" if inverse else "+"
    rounds = f"sequence({ROUNDS - 1}, 0)" if inverse else f"sequence(0, {ROUNDS - 1})"
    return (
        f"aggregate({rounds}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 0, "
        f"named_struct('l', pmod(s.l {sign} pmod({f('s.r')}, {a}), {a}), 'r', s.r), named_struct('l', s.l, 'r', pmod(s.r {sign} pmod({f('s.l')}, {b}), {b}))))"
    )


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _ten(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def permuted_digits(d: str, kind: str, key: str, inverse: bool = False) -> str:
    """SQL of a string of up to 36 decimal digits, permuted among the strings of its length."""
    n = f"length({d})"
    k = f"({n} div 2)"
    net = feistel(f"concat('0', substring({d}, 1, {k}))", f"concat('0', substring({d}, {k} + 1))", _ten(k), _ten(f"({n} - {k})"), kind, key, inverse)
    # lpad to length 0 would cut, so the left half of a single digit comes out empty as it should
    return _let("fd", net, f"concat(lpad(cast(fd.l as string), {k}, '0'), lpad(cast(fd.r as string), {n} - {k}, '0'))")


def luhn_sum(d: str) -> str:
    """SQL of the Luhn sum of a digit string, its last digit counted once."""
    v = f"cast(substring({d}, length({d}) - j, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, j) -> t + if(j % 2 = 0, {v}, {v} * 2 - if({v} > 4, 9, 0)))"


def _mod97(s: str) -> str:
    """SQL of the remainder by 97 of a string whose letters count as 10 to 35."""
    c = "substring(" + s + ", j, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, j) -> if({c} rlike '[0-9]', t * 10 + cast(if({c} rlike '[0-9]', {c}, '0') as int), t * 100 + ascii({c}) - 55) % 97)"


def _into(form: str, digits: str) -> str:
    """SQL of form with its digits replaced, in order, by those of digits."""
    return f"aggregate(split({form}, ''), named_struct('o', '', 'p', 1), (s, c) -> if(c rlike '[0-9]', named_struct('o', concat(s.o, substring({digits}, s.p, 1)), 'p', s.p + 1), named_struct('o', concat(s.o, c), 'p', s.p)), s -> s.o)"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _date(m: str, p: PiiParams) -> str:
    """Permuted date in the form of m, or null if it isn't one of 1800 to 2199."""
    num = "[0-9]+"
    parts = f"transform(regexp_extract_all({m}, '{num}', 0), x -> cast(x as int))"
    first, second = ("dp[1]", "dp[0]") if p.month_first else ("dp[0]", "dp[1]")  # day, month of a slash date

    def valid(y: str, mo: str, d: str) -> str:
        return f"({mo} between 1 and 12 and {d} between 1 and 31 and {y} between 1800 and 2199 and {d} <= day(last_day(make_date(if({y} between 1800 and 2199, {y}, 2000), if({mo} between 1 and 12, {mo}, 1), 1))))"

    def made(y: str, mo: str, d: str) -> str:
        return f"make_date({y}, {mo}, {d})"

    def number(day: str) -> str:
        return f"cast(datediff({day}, date'1800-01-01') as bigint)"

    def moved(day: str) -> str:
        return _let("dn", number(day), _let("df", feistel("dn div 773", "dn % 773", "189", "773", "date", p.key), "date_add(date'1800-01-01', cast(df.l * 773 + df.r as int))"))

    def pad(v: str, i: int) -> str:
        """Day or month as wide as it was written: one digit stays one digit if it can."""
        return f"if(length(element_at(regexp_extract_all({m}, '{num}', 0), {i})) = 2, lpad(cast({v} as string), 2, '0'), cast({v} as string))"

    iso = f"if({valid('dp[0]', 'dp[1]', 'dp[2]')}, date_format({moved(made('dp[0]', 'dp[1]', 'dp[2]'))}, 'yyyy-MM-dd'), null)"

    def short(day_at: int, sep: str, y: str, mo: str, d: str) -> str:
        a, b = ("day(nd)", "month(nd)") if day_at == 1 else ("month(nd)", "day(nd)")
        return _let("nd", moved(made(y, mo, d)), f"concat({pad(a, 1)}, '{sep}', {pad(b, 2)}, '{sep}', lpad(cast(year(nd) as string), 4, '0'))")

    dot = f"if({valid('dp[2]', 'dp[1]', 'dp[0]')}, {short(1, '.', 'dp[2]', 'dp[1]', 'dp[0]')}, null)"
    main_at, other_at = (2, 1) if p.month_first else (1, 2)
    slash = (
        f"case when {valid('dp[2]', second, first)} then {short(main_at, '/', 'dp[2]', second, first)} "
        f"when {valid('dp[2]', first, second)} then {short(other_at, '/', 'dp[2]', first, second)} end"
    )
    return _let("dp", parts, f"case when instr({m}, '-') > 0 then {iso} when instr({m}, '.') > 0 then {dot} else {slash} end")


def pseudonym(kind: str, m: str, p: PiiParams) -> str:
    """SQL of the pseudonym of the match m (SQL of a string), or null if it isn't valid."""
    if kind == "email":
        return f"concat('u', substring(sha2(concat({_q(p.key + '|email|')}, lower({m})), 256), 1, 16), '@mail.invalid')"
    if kind == "secret":
        value = f"regexp_extract({m}, '[A-Za-z0-9+/_-]++$', 0)"
        stream = _let("sd", f"sha2(concat({_q(p.key + '|secret|')}, sv), 256)", "array_join(transform(sequence(0, (length(sv) - 1) div 64), i -> sha2(concat(sd, '|', i), 256)), '')")
        made = f"substring({stream}, 1, length(sv))"
        return _let("sv", value, f"concat(substring({m}, 1, length({m}) - length(sv)), if(sv = upper(sv), upper({made}), {made}))")
    if kind == "iban":
        # the country stays; the digits of the account are permuted, and the check digits follow
        flat = f"replace({m}, ' ', '')"
        account = "substring(ib, 5)"
        new = f"concat(substring(ib, 1, 2), lpad(cast(98 - {_mod97('concat(nb, substring(ib, 1, 2), \"00\")')} as string), 2, '0'), nb)"
        body = _let("nb", _into(account, permuted_digits(_digits(account), "iban", p.key)), _let("ni", new, _letters_into(m, "ni")))
        return _let("ib", flat, f"if({_mod97('concat(substring(ib, 5), substring(ib, 1, 4))')} = 1 and length({_digits(account)}) > 1, {body}, null)")
    if kind == "ip":
        octets = f"transform(split({m}, '[.]'), x -> cast(x as bigint))"
        net = feistel("o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536", "ip", p.key)
        return _let("o", octets, f"if(exists(o, x -> x > 255), null, {_let('f', net, 'concat_ws(\".\", f.l div 256, f.l % 256, f.r div 256, f.r % 256)')})")
    if kind == "date":
        return _date(m, p)
    if kind == "ssn":
        # areas 001-665 and 667-899, groups 01-99, serials 0001-9999
        parts = f"transform(split({m}, '-'), x -> cast(x as bigint))"
        net = feistel("(sn[0] - if(sn[0] > 666, 2, 1)) * 99 + sn[1] - 1", "sn[2] - 1", "88902", "9999", "ssn", p.key)
        made = "concat(lpad(cast(f.l div 99 + if(f.l div 99 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(f.r + 1 as string), 4, '0'))"
        return _let("sn", parts, f"if(sn[0] in (0, 666) or sn[0] > 899 or sn[1] = 0 or sn[2] = 0, null, {_let('f', net, made)})")
    if kind == "card":
        # the first digit names the scheme and stays; the last one is the check digit
        inner = permuted_digits("substring(cd, 2, length(cd) - 2)", "card", p.key)
        check = f"cast(pmod(10 - {luhn_sum('concat(cn, \"0\")')} % 10, 10) as string)"
        made = _let("cn", f"concat(substring(cd, 1, 1), {inner})", _let("cc", f"concat(cn, {check})", _into(m, "cc")))
        return _let("cd", _digits(m), f"if({luhn_sum('cd')} % 10 = 0 and not cd rlike '^(.)\\\\1*$', {made}, null)")
    if kind == "phone":
        # the country code stays: what stands before the last ten digits, or the first two of another international number
        keep = f"case when {m} rlike '[0-9]{{3}}[)]?[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}$' then length(pd) - 10 else 2 end"
        made = _let("pk", keep, _let("pn", f"concat(substring(pd, 1, pk), {permuted_digits('substring(pd, pk + 1)', 'phone', p.key)})", _into(m, "pn")))
        return _let("pd", _digits(m), f"if(length(pd) between 8 and 15, {made}, null)")
    raise ValueError(kind)


def _letters_into(form: str, flat: str) -> str:
    """SQL of form with its characters other than spaces replaced, in order, by those of flat."""
    return f"aggregate(split({form}, ''), named_struct('o', '', 'p', 1), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'p', s.p), named_struct('o', concat(s.o, substring({flat}, s.p, 1)), 'p', s.p + 1)), s -> s.o)"


def _iban(n: int) -> str:
    return rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"(?: ?[A-Z0-9]{{{n % 4}}})" if n % 4 else "")


def _card(n: int) -> str:
    return rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}"


def _candidates(window: str, forms: list[str]) -> str:
    """SQL of the strings of a form that start at any place of t and end with a word; window: where the longest may end."""
    starts = _NOT_IN_WORD + f"(?=({window}[A-Za-z0-9]?))"
    each = ", ".join(f"regexp_extract(w, {_q(f'^({x})' + _END)}, 1)" for x in forms)
    return f"array_distinct(filter(flatten(transform(regexp_extract_all(t, {_q(starts)}, 1), w -> array({each}))), x -> x <> ''))"


def valid_ibans() -> str:
    """SQL of the IBANs of t that pass mod 97, wherever they start and end, those tried first in front."""
    flat = "replace(x, ' ', '')"
    ok = f"filter({_candidates('[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?', [_iban(n) for n in range(12, 36)])}, x -> {_mod97(f'concat(substring({flat}, 5), substring({flat}, 1, 4))')} = 1)"
    own = " or ".join(f"length({flat}) = {n} and substring(x, 1, 2) in ({', '.join(map(_q, c))})" for n, c in IBAN_LENGTHS.items())
    return f"transform(array_sort(transform({ok}, x -> named_struct('o', if({own}, 0, 1), 'n', -length({flat}), 'x', x))), y -> y.x)"


def valid_cards() -> str:
    """SQL of the card numbers of t that pass Luhn, wherever they start and end, the longest in front."""
    ok = f"filter({_candidates(_card(13)[:-4] + '{12,18}', [_card(n) for n in range(13, 20)])}, x -> {luhn_sum(_digits('x'))} % 10 = 0)"
    return f"transform(array_sort(transform({ok}, x -> named_struct('n', -length({_digits('x')}), 'x', x))), y -> y.x)"


def any_pii() -> str:
    """SQL of the pattern of all kinds; of IBANs and cards, the valid ones in the columns ibans and cards."""

    def listed(values: str) -> str:
        return f"if(size({values}) > 0, concat({_q(_NOT_IN_WORD + '(?:')}, array_join({values}, '|'), {_q(')' + _END)}), '(?!)')"

    each = [listed(k + "s") if k in ("iban", "card") else _q(x) for k, x in KINDS.items()]
    return "concat('(?:', " + ", ')|(?:', ".join(each) + ", ')')"


def kind_of(m: str) -> str:
    """SQL of the kind of a match: the first whose pattern is all of it."""
    whens = " ".join(f"when {f'array_contains({k}s, {m})' if k in ('iban', 'card') else f'{m} rlike ' + _q('^(?:' + x + ')$')} then '{k}'" for k, x in KINDS.items())
    return f"case {whens} end"


def pseudonymize(docs: DataFrame, params: PiiParams, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """docs with the personal data of text_col replaced; found_col: also an array of struct<kind, pseudonym> of what was.

    All other columns stay as they are. Null and empty texts, and texts without valid values, come back unchanged. Repeated
    rows get equal pseudonyms; where two kinds could take one place, the first of KINDS does. An empty table gives an empty
    result. Texts of any length: every group of a pattern has a bound, but in a text of digit groups alone the time grows
    with the square of its length.
    IBANs and cards are found by their check digits first, at every start and length; the pattern of a text then names the
    valid ones, and the other kinds' patterns fit valid values only, so what isn't valid hides nothing behind it. Everything is an expression on the row: no shuffle, no Python.
    """
    case = " ".join(f"when k = '{k}' then {pseudonym(k, 'm', params)}" for k in KINDS)
    one = _let("k", kind_of("m"), f"named_struct('kind', k, 'old', m, 'new', case {case} end)")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("t"))
    may = F.col("t").rlike("[0-9@]")
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("ibans", F.when(may, F.expr(valid_ibans())).otherwise(none)).withColumn("cards", F.when(may, F.expr(valid_cards())).otherwise(none))
    rows = rows.withColumn("rx", F.expr(any_pii()))
    # a secret is the only kind that needs neither a digit nor an @
    rows = rows.withColumn("ms", F.when(may | F.col("t").rlike(SECRET), F.expr("regexp_extract_all(t, rx, 0)")))
    rows = rows.withColumn("found", F.expr(f"case when size(ms) > 0 then transform(ms, m -> {one}) end"))
    parts = F.expr("split(t, rx, -1)")
    fill = F.expr("transform(found, x -> coalesce(x.new, x.old))")
    new = F.when(F.col("found").isNotNull(), F.array_join(F.zip_with(parts, F.concat(fill, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")).otherwise(F.col("t"))
    out = [(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c)) for c in docs.columns]
    if found_col:
        valid = F.expr("transform(filter(coalesce(found, array()), x -> x.new is not null), x -> named_struct('kind', x.kind, 'pseudonym', x.new))")
        out.append(valid.alias(found_col))
    return rows.select(*out)
