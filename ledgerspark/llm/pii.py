"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation of each validated value within its format.

Equal values get equal pseudonyms wherever they stand, different values of one format different ones, and none can be
turned back without the key. Built-in expressions only; texts without a candidate are left after one test.

Formats: e-mail addresses (the part before @, letters of the common scripts within their own rows of the alphabet; a part with
any other character becomes x and 24 hexadecimal digits of a keyed hash), telephone numbers with + or a bracketed area code (the digits after the
first), IPv4 addresses (each part up to 255), dates that exist (years 1600 to 2399, in figures, year first or last),
card numbers (13 to 19 digits that pass the Luhn check, which their pseudonyms pass too, also beside other groups of
digits), numbers of the form 000-00-0000, and secrets of 32 to 128 hexadecimal digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: For tests and measurements; pass a secret of your own.
KEY = "ledgerspark-demo-key"

#: What may be personal, but for card numbers, tried in this order at each place.
PATTERN = "|".join((
    r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,24}",
    r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])",
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,4}){3,5}(?![0-9])",
    r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    r"(?<![0-9+])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
    r"(?<![0-9])(?:[0-9]{4}([-./])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-./])[0-9]{2}\2[0-9]{4})(?![0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
))
#: Groups of digits in which card numbers are looked for, where none of the above stands.
DIGITS = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,}+"


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digest(key: str, round_: str, value: str) -> str:
    """128 hexadecimal digits of a keyed hash."""
    return f"concat(sha2(concat('{key}|', {round_}, '|', {value}), 256), sha2(concat('{key}#', {round_}, '|', {value}), 256))"


#: First code point and size of each class of characters that are permuted among themselves; others stay.
CLASSES = ((48, 10), (97, 26), (65, 26))
#: Letters of other scripts, in rows without gaps: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Han, Hangul.
LETTERS = (
    (192, 23), (216, 7), (224, 23), (248, 8), (256, 128), (913, 17), (931, 7), (945, 25), (1024, 16), (1040, 32), (1072, 32), (1104, 16),
    (1488, 27), (1569, 26), (1601, 10), (2309, 53), (3585, 46), (12353, 86), (12449, 90), (19968, 20992), (44032, 11172),
)
_HEX = "0123456789abcdef"


def _shift(text: str, digest: str, hexadecimal: bool, letters: bool) -> str:
    """Each character moved within its class by two digits of the digest; by four where all letters may occur."""
    width = 4 if letters else 2
    by = f"cast(conv(substr(g, {width} * (i - 1) + 1, {width}), 16, 10) as int)"
    if hexadecimal:
        moved = f"substr('{_HEX}', (instr('{_HEX}', c) - 1 + {by}) % 16 + 1, 1)"
    else:
        cases = " ".join(f"when u between {first} and {first + n - 1} then {first} + (u - {first} + {by}) % {n}" for first, n in CLASSES + LETTERS * letters)
        shown = "decode(unhex(lpad(hex({}), 4, '0')), 'UTF-16BE')" if letters else "chr({})"
        moved = _let("ascii(c)", "u", _let(f"case {cases} end", "w", f"if(w is null, c, {shown.format('w')})"))
    one = _let("substr(t, i, 1)", "c", moved)
    return _let(text, "t", f"if(length(t) = 0, '', {_let(digest, 'g', f'''array_join(transform(sequence(1, length(t)), i -> {one}), '')''')})")


def feistel(value: str, key: str, hexadecimal: bool = False, letters: bool = False) -> str:
    """An SQL expression: the value with its characters permuted. The halves take turns; each moves by a hash of the other."""
    step = f"named_struct('l', a.r, 'r', {_shift('a.l', _digest(key, 'k', 'a.r'), hexadecimal, letters)})"
    start = "named_struct('l', substr(v, 1, length(v) div 2), 'r', substr(v, length(v) div 2 + 1))"
    return _let(value, "v", f"aggregate(sequence(1, {ROUNDS}), {start}, (a, k) -> {step}, a -> concat(a.l, a.r))")


def feistel_number(value: str, key: str, rows: int, columns: int) -> str:
    """An SQL expression: a permutation of 0 .. rows * columns - 1."""
    by = lambda k, x, n: f"cast(conv(substr(sha2(concat('{key}|', k, '{k}', {x}), 256), 1, 12), 16, 10) as bigint) % {n}"
    first = f"named_struct('p', (a.p + {by('p', 'a.q', rows)}) % {rows}, 'q', a.q)"
    step = _let(first, "b", f"named_struct('p', b.p, 'q', (b.q + {by('q', 'b.p', columns)}) % {columns})")
    start = f"named_struct('p', cast(v div {columns} as bigint), 'q', cast(v % {columns} as bigint))"
    return _let(value, "v", f"aggregate(sequence(1, {ROUNDS // 2}), {start}, (a, k) -> {step}, a -> a.p * {columns} + a.q)")


def luhn(digits: str) -> str:
    """An SQL expression: the Luhn sum of a string of digits, modulo 10."""
    digit = "cast(substr(d, length(d) - i + 1, 1) as int)"
    twice = _let(digit, "x", "if(i % 2 = 0, x * 2 - if(x > 4, 9, 0), x)")
    return _let(digits, "d", f"aggregate(sequence(1, length(d)), 0, (s, i) -> s + {twice}) % 10")


def _secret(m: str, key: str) -> str:
    """In hexadecimal, whichever case it is written in; digits alone stay digits."""
    moved = _let(feistel(f"lower({m})", key, True), "h", f"if({m} = upper({m}), upper(h), h)")
    return f"if({m} rlike '^[0-9]+$', {feistel(m, key)}, {moved})"


#: Local parts of these characters are permuted; any other is replaced by a keyed hash.
_PERMUTED = "^[._%+" + "".join(f"{chr(first)}-{chr(first + n - 1)}" for first, n in CLASSES + LETTERS) + "-]+$"


def _email(m: str, key: str) -> str:
    hashed = f"concat('x', substr(sha2(concat('{key}|@|', l), 256), 1, 24))"
    body = f"concat(if(l rlike '{_PERMUTED}', {feistel('l', key, letters=True)}, {hashed}), '@', substring_index({m}, '@', -1))"
    return _let(f"substring_index({m}, '@', 1)", "l", body)


def _redealt(m: str, digits: str) -> str:
    """m with its digits replaced by those of the other string, in order; what stands between them stays."""
    here = f"if(substr({m}, i, 1) between '0' and '9', substr(n, length(regexp_replace(substr({m}, 1, i), '[^0-9]', '')), 1), substr({m}, i, 1))"
    return _let(digits, "n", f"array_join(transform(sequence(1, length({m})), i -> {here}), '')")


def _phone(m: str, key: str) -> str:
    """All digits but the first, whatever stands between them."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return _redealt(m, f"concat(substr({digits}, 1, 1), {feistel(f'substr({digits}, 2)', key)})")


def _ip(m: str, key: str) -> str:
    parts = f"split({m}, '\\\\.')"
    packed = "array_join(transform(o, x -> lpad(lower(hex(cast(x as bigint))), 2, '0')), '')"
    shown = "concat_ws('.', transform(sequence(1, 7, 2), i -> conv(substr(h, i, 2), 16, 10)))"
    return _let(parts, "o", f"if(exists(o, x -> cast(x as int) > 255), {m}, {_let(feistel(packed, key, True), 'h', shown)})")


#: Days of 400 Gregorian years, 189 * 773, after which the calendar repeats.
CYCLE = (189, 773)


def _date(m: str, key: str) -> str:
    """Within the 400 years of its own calendar cycle, in its own notation: year, month, day; day, month, year; or, where
    that is no date, month, day, year."""
    orders = ("'yyyy', s, 'MM', s, 'dd'", "'dd', s, 'MM', s, 'yyyy'", "'MM', s, 'dd', s, 'yyyy'")
    notations = f"transform(array(regexp_extract({m}, '[-./]', 0)), s -> array({', '.join(f'concat({o})' for o in orders)}))[0]"
    fitting = f"filter({notations}, p -> try_to_timestamp({m}, p) is not null)"
    start = "make_date(cast(1600 + 400 * ((year(d) - 1600) div 400) as int), 1, 1)"
    moved = f"date_format(date_add(f, cast({feistel_number('datediff(d, f)', key, *CYCLE)} as int)), n)"
    body = f"if(year(d) not between 1600 and 2399, {m}, {_let(start, 'f', moved)})"
    dated = _let(f"cast(try_to_timestamp({m}, n) as date)", "d", body)
    return _let(f"get({fitting}, 0)", "n", f"if(n is null, {m}, {dated})")


def _card(m: str, key: str) -> str:
    """All digits but the last, whatever stands between them; the last by the Luhn check."""
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    check = f"cast((10 - {luhn("concat(b, '0')")}) % 10 as string)"
    moved = _let(feistel(f"substr({digits}, 1, length({digits}) - 1)", key), "b", f"concat(b, {check})")
    return _redealt(m, moved)


def _cards(run: str, key: str) -> str:
    """(text, n) of a run of groups of digits with the n card numbers in it replaced. They begin and end with a group.

    A group begins at most one, the longest that passes. From the left, of a number and those that begin inside it, the
    longest is taken, then the first.
    """
    joined = "regexp_replace(array_join(slice(g, s, w), ''), '[^0-9]', '')"
    passes = _let(joined, "j", f"if(length(j) between 13 and 19, {luhn('j')} = 0, false)")
    widest = f"get(filter(sequence(least(19, size(g) - s + 1), 1, -1), w -> {passes}), 0)"
    # the start is negative, so that the greatest is the longest, then the first
    begun = _let(widest, "w", f"if(w is null, null, named_struct('n', length({joined}), 's', -s, 'e', s + w))")
    cards = f"filter(transform(sequence(1, size(g)), s -> {begun}), c -> c is not null)"
    # at most 18 of those that follow can begin inside one
    pick = "array_max(filter(slice(cs, k, 19), d -> -d.s < element_at(cs, k).e))"
    take = _let(pick, "p", "named_struct('e', p.e, 'o', concat(a.o, array(p)))")
    start = "named_struct('e', 1, 'o', cast(array() as array<struct<n: int, s: int, e: int>>))"
    chosen = f"aggregate(sequence(1, size(cs)), {start}, (a, k) -> if(-element_at(cs, k).s < a.e, a, {take}), a -> a.o)"
    card = _let("array_join(slice(g, -c.s, c.e + c.s), '')", "m", _card("m", key))
    part = _let("coalesce(get(o, i - 1).e, 1)", "x", f"concat(array_join(slice(g, x, -c.s - x), ''), {card})")
    rest = "array_join(slice(g, element_at(o, -1).e, size(g)), '')"
    text = f"concat(array_join(transform(o, (c, i) -> {part}), ''), {rest})"
    replaced = _let(chosen, "o", f"named_struct('text', {text}, 'n', size(o))")
    some = _let(cards, "cs", f"if(size(cs) = 0, named_struct('text', r, 'n', 0), {replaced})")
    # each group with the separator that follows it
    return _let(run, "r", _let("regexp_extract_all(r, '[0-9]+[ -]?', 0)", "g", some))


def _between(b: str, key: str) -> str:
    """(text, n) of a text without other candidates, with its n card numbers replaced."""
    runs = f"transform(regexp_extract_all({b}, {_quoted(DIGITS)}, 0), r -> {_cards('r', key)})"
    text = f"array_join(zip_with(split({b}, {_quoted(DIGITS)}), rs, (x, y) -> concat(x, coalesce(y.text, ''))), '')"
    found = _let(runs, "rs", f"named_struct('text', {text}, 'n', aggregate(rs, 0, (n, y) -> n + y.n))")
    return f"if({b} rlike {_quoted(DIGITS)}, {found}, named_struct('text', {b}, 'n', 0))"


def pseudonym(m: str, key: str) -> str:
    """An SQL expression: the pseudonym of a candidate, or the candidate where it isn't valid."""
    return f"""case
      when instr({m}, '@') > 0 then {_email(m, key)}
      when {m} rlike '^[0-9A-Fa-f]{{32,128}}$' then {_secret(m, key)}
      when substr({m}, 1, 1) in ('+', '(') then {_phone(m, key)}
      when {m} rlike '^[0-9]{{1,3}}(?:\\\\.[0-9]{{1,3}}){{3}}$' then {_ip(m, key)}
      when {m} rlike '^(?:[0-9]{{4}}([-./])[0-9]{{2}}\\\\1[0-9]{{2}}|[0-9]{{2}}([-./])[0-9]{{2}}\\\\2[0-9]{{4}})$' then {_date(m, key)}
      else {feistel(m, key)} end"""


def pseudonymize(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with personal data in text replaced, and n_private long: how many values were.

    Whole texts. Null texts stay null, with 0; empty texts and texts without valid values stay as they are. Equal values
    get equal pseudonyms in all rows. A column n_private of docs is replaced, so are __found, __new and __between; all others pass. key must not hold quotes.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key must not hold quotes or backslashes")
    text = F.col("text").cast("string")
    some = text.rlike(PATTERN) | text.rlike(DIGITS)
    out = docs.withColumn("text", text)
    out = out.withColumn("__found", F.when(some, F.expr(f"regexp_extract_all(text, {_quoted(PATTERN)}, 0)")))
    out = out.withColumn("__new", F.expr(f"transform(__found, m -> {pseudonym('m', key)})"))
    # what stands between those: with the card numbers in it replaced
    out = out.withColumn("__between", F.when(F.col("__found").isNotNull(), F.expr(f"transform(split(text, {_quoted(PATTERN)}), b -> {_between('b', key)})")))
    whole = F.array_join(F.zip_with("__between", "__new", lambda a, b: F.concat(a["text"], F.coalesce(b, F.lit("")))), "")
    count = F.size(F.filter(F.zip_with("__found", "__new", lambda a, b: a != b), lambda x: x))
    count = count + F.aggregate("__between", F.lit(0), lambda n, b: n + b["n"])
    out = out.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(whole))
    return out.withColumn("n_private", F.when(F.col("__found").isNull(), 0).otherwise(count).cast("long")).drop("__found", "__new", "__between")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
