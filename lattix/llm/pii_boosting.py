"""Personal data: generators propose spans, boosted trees select them. DataFrame and SQL functions only.

Spans of four strict patterns with their checks are always taken. Wider generators propose further,
overlapping candidates outside them: a run of digit groups gives every span of whole groups with enough digits. Secrets, of
which there is no strict pattern, are only proposed: what is assigned to a name like password, and long runs of letters and digits.
Gradient-boosted trees score each by its format and context; of those that reach thresholds, calibrated
on held-out examples, the best that don't overlap are chosen. The trees are grown in numpy on the driver, on some thousands of examples
that rules make; on the corpus they are one SQL expression. Nothing is shuffled: a row's spans are found in the row.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MARK = "\\u0001"

#: Loops are possessive, so that long runs neither backtrack nor recurse. A match begins where a run begins or the last match ended.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++",
    # without ' at ', which may take the name of the next address as its host
    "marked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++",
    "ip": r"(?<![A-Za-z0-9:.])(?:(?:H:){7}+H|(?:H(?::H){0,6}+)?+::(?:H(?::H){0,6}+)?+(?![A-Za-z0-9:]))".replace("H", "[0-9A-Fa-f]{1,4}"),
    # the value is what follows the last sign and quote
    "assigned": r"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credentials?|(?:api|access|private|client|auth|account)[_-]?key|bearer)[\"']?[ \t]{0,2}(?:[:=]|is)?[ \t]{0,2}[\"']?[A-Za-z0-9_+/=~!@#$%^&*\-]++(?:\.[A-Za-z0-9_+/=~!@#$%^&*\-]++)*+",
    "token": r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_-]{0,40}[0-9])[A-Za-z0-9_-]{16,}+(?![@.]?[A-Za-z0-9])",
    "number": r"(?<![A-Za-z0-9])\+?\(?[0-9]++(?:[ ().\-/]{1,2}+[0-9]++)*+",
}
#: Digits of a number that is proposed, at least and at most.
DIGITS = (7, 19)
BEFORE, AFTER = 40, 12
#: Characters that no pattern takes, strict or wide; pieces of a text end at one.
BETWEEN = r"[\n,;<>|{}?]"
#: Characters of a piece, at least.
PIECE = 4000
CUES = {
    "cue_phone": "phone|tel|call|mobil|fax|dial|whatsapp|sms",
    "cue_email": "mail|contact|write|reach",
    "cue_card": "card|visa|credit|payment|master|amex|debit",
    "cue_ip": "ip|host|server|addr|login|session",
    "cue_secret": "pass|pwd|secret|token|key|auth|bearer|credential",
    "cue_hash": "sha|md5|commit|hash|digest|uuid|checksum|rev|file|img|image",
    "cue_other": "order|invoice|isbn|version|build|id|date|time|page|ref|sku|serial|total|price|code|number",
}
FEATURES = ("kind", "n_digits", "n_chars", "n_spaces", "n_dots", "n_dashes", "n_parens", "n_colons", "n_slashes", "plus", "luhn", "date", "groups", "touch_before", "touch_after", "more_before", "more_after", "said_at", "said_dot", "first", "n_upper", "n_lower", "hexadecimal", "assigned", *CUES)

TREES, DEPTH, SHRINK = 40, 4, 0.3
#: Cuts that a tree tries of a feature, at most.
CUTS = 12
#: What share of a kind's chosen held-out examples has to be right.
PRECISION = 0.98
EXAMPLES = 4000


def luhn(digits: str) -> str:
    """SQL for whether a digit string passes Luhn's check."""
    weighed = f"transform(sequence(1, length({digits})), i -> int(substr({digits}, length({digits}) - i + 1, 1)) * if(i % 2 = 0, 2, 1))"
    return f"(length({digits}) > 0 and aggregate({weighed}, 0, (a, x) -> a + if(x > 9, x - 9, x)) % 10 = 0)"


def _digits(p: str) -> str:
    return f"regexp_replace({p}, '[^0-9]', '')"


def spans_sql(text: str, pattern: str, kind: str, valid: str, guard: str = "true") -> str:
    """SQL for an array of (first, kind, past, what): the leftmost matches that are valid; p stands for a match."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    pieces = f"split(regexp_replace({text}, '{quoted}', '{MARK}$0{MARK}'), '{MARK}', -1)"
    none = "cast(array() as array<struct<first: int, kind: int, past: int, what: string>>)"
    grown = f"if(a.odd and {valid}, array_append(a.out, named_struct('first', a.at, 'kind', {kind}, 'past', a.at + length(p), 'what', p)), a.out)"
    return f"if({guard}, aggregate({pieces}, named_struct('at', 0, 'odd', false, 'out', {none}), (a, p) -> named_struct('at', a.at + length(p), 'odd', not a.odd, 'out', {grown}), a -> a.out), {none})"


def with_blocks(df: DataFrame, text_col: str, chars: int) -> DataFrame:
    """Adds __blocks, the text in pieces (at, size, pre, text) that begin at at with size characters; text has pre more before these, and some after.

    A piece ends at the first character after chars ones that no span of any kind can have, so spans lie in one piece each, and what is done for a piece costs the same in a text of any
    length. The characters around it are those that features look at. Null counts as empty, and the mark character is replaced by another.
    """
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\u0001", "\u0002")
    df = df.withColumn("__parts", F.regexp_extract_all(text, F.lit(f"(?s).{{{chars},}}?{BETWEEN}|.+"), F.lit(0)))
    df = df.withColumn("__starts", F.expr("aggregate(__parts, named_struct('at', 0, 'out', cast(array() as array<int>)), (a, p) -> named_struct('at', a.at + length(p), 'out', array_append(a.out, a.at)), a -> a.out)"))
    before, after = f"if(i = 0, '', right(__parts[i - 1], {BEFORE}))", f"if(i + 1 < size(__parts), left(__parts[i + 1], {AFTER}), '')"
    return df.withColumn("__blocks", F.expr(f"transform(__parts, (p, i) -> named_struct('at', __starts[i], 'size', length(p), 'pre', length({before}), 'text', concat({before}, p, {after})))"))


def base_sql(text: str) -> str:
    """SQL for the strict spans, in order."""
    n = f"length({_digits('p')})"
    valid = {
        "email": "true",
        "ip": f"p rlike '^{OCTET}(?:\\\\.{OCTET}){{3}}$'",
        "card": f"{n} between 12 and 19 and {luhn(_digits('p'))}",
        "phone": f"{n} between 9 and 15",
    }
    guard = {"email": f"instr({text}, '@') > 0", "ip": "true", "card": "true", "phone": f"instr({text}, '+') > 0"}
    return f"array_sort(concat({', '.join(spans_sql(text, STRICT[k], str(i), valid[k], guard[k]) for i, k in enumerate(BASE))}))"


def masked_sql(text: str, base: str) -> str:
    """SQL for the text with a character that no candidate has for each character of a base span."""
    step = f"(a, b) -> if(b.past <= a.at, a, named_struct('at', b.past, 'out', concat(a.out, substring({text}, a.at + 1, greatest(b.first - a.at, 0)), repeat('\\u0003', b.past - greatest(b.first, a.at)))))"
    masked = f"aggregate({base}, named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring({text}, a.at + 1)))"
    return f"if(size({base}) = 0, {text}, {masked})"


def groups_sql(r: str) -> str:
    """SQL for the digit groups of a run: lead, the + and ( before it, first, past, n digits and so many before them in the run."""
    pieces = f"split(regexp_replace({r}.what, '[0-9]+', '{MARK}$0{MARK}'), '{MARK}', -1)"
    none = "cast(array() as array<struct<lead: string, first: int, past: int, n: int, earlier: int>>)"
    lead = "if(size(a.out) = 0, a.gap, if(endswith(a.gap, '('), '(', ''))"
    grown = f"array_append(a.out, named_struct('lead', {lead}, 'first', a.at, 'past', a.at + length(p), 'n', length(p), 'earlier', a.n))"
    step = f"if(a.odd, named_struct('at', a.at + length(p), 'odd', false, 'gap', '', 'n', a.n + length(p), 'out', {grown}), named_struct('at', a.at + length(p), 'odd', true, 'gap', p, 'n', a.n, 'out', a.out))"
    return f"aggregate({pieces}, named_struct('at', {r}.first, 'odd', false, 'gap', '', 'n', 0, 'out', {none}), (a, p) -> {step}, a -> a.out)"


def numbers_sql(text: str) -> str:
    """SQL for every span of whole digit groups with DIGITS digits, as card and as phone. A ( before it belongs to it if ) follows."""
    low, high = DIGITS
    body = "substring(r.what, x.first - r.first + 1, y.past - x.first)"
    lead = f"if(instr(x.lead, '(') = 0 or instr({body}, ')') > 0, x.lead, '')"
    span = f"transform(array({lead}), l -> named_struct('first', x.first - length(l), 'kind', 2, 'past', y.past, 'what', concat(l, {body})))[0]"
    ends = f"filter(slice(g, i + 1, {high}), y -> y.earlier + y.n - x.earlier between {low} and {high})"
    spans = f"flatten(transform({spans_sql(text, WIDE['number'], '2', f'length({_digits(chr(112))}) >= {low}')}, r -> flatten(transform(array({groups_sql('r')}), g -> flatten(transform(g, (x, i) -> transform({ends}, y -> {span})))))))"
    return f"flatten(transform({spans}, c -> array(c, named_struct('first', c.first, 'kind', 3, 'past', c.past, 'what', c.what))))"


def secrets_sql(text: str) -> str:
    """SQL for values that are assigned to a secret's name, and for long runs of letters and digits."""
    sign = "^(?:[^:=\\\\s]*[:=\\\\s]+)(?:is\\\\s+)?[\"\\']?"
    value = f"regexp_replace(c.what, '{sign}', '')"
    guard = f"{text} rlike '(?i)pass|pwd|secret|token|credential|key|bearer'"
    cut = f"transform({spans_sql(text, WIDE['assigned'], '4', 'true', guard)}, c -> named_struct('first', c.past - length({value}), 'kind', 4, 'past', c.past, 'what', {value}))"
    return f"concat(filter({cut}, c -> length(c.what) >= 6), {spans_sql(text, WIDE['token'], '4', 'true')})"


def candidates_sql(text: str) -> str:
    """SQL for the candidates, which may overlap."""
    email = [spans_sql(text, WIDE[k], "0", "true", f"{text} rlike '@|[(]at[)]|at]| at '") for k in ("email", "marked")]
    ip = spans_sql(text, WIDE["ip"], "1", f"length(p) > 2 and (not contains(p, '::') or size(regexp_extract_all(p, '[0-9A-Fa-f]+', 0)) <= 7)", f"instr({text}, ':') > 0")
    return f"concat(array_distinct(concat({', '.join(email)})), {ip}, {numbers_sql(text)}, array_distinct({secrets_sql(text)}))"


def features_sql(text: str, c: str) -> str:
    """SQL for a struct of what the trees read of a candidate."""
    count = lambda of: f"length(regexp_replace({c}.what, '[^{of}]', ''))"
    near = f"named_struct('before', lower(substring({text}, greatest({c}.first - {BEFORE}, 0) + 1, least({c}.first, {BEFORE}))), 'after', substring({text}, {c}.past + 1, {AFTER}))"
    before, after = "w.before", "w.after"
    values = {
        "kind": f"{c}.kind", "n_digits": count("0-9"), "n_chars": f"length({c}.what)", "n_spaces": count(" "), "n_dots": count("."), "n_dashes": count("-"), "n_parens": count("()"), "n_colons": count(":"), "n_slashes": count("/"),
        "plus": f"int(startswith({c}.what, '+'))",
        "luhn": f"int({c}.kind = 2 and {luhn(_digits(f'{c}.what'))})",
        "date": f"int({c}.what rlike '(?:19|20)[0-9]{{2}}[-/. ][01]?[0-9][-/. ][0-3]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)[0-9]{{2}}')",
        "groups": f"int({c}.what rlike '^(?:[0-9]{{4}}[ -]){{3}}[0-9]{{1,7}}$') + 2 * int({c}.what rlike '^[+]?[0-9]{{0,3}}[ .-]?[(]?[0-9]{{2,4}}[)]?[ .-][0-9]{{3,4}}[ .-]?[0-9]{{3,4}}$')",
        "touch_before": f"int({before} rlike '[a-z0-9_$#=/-]$')", "touch_after": f"int({after} rlike '^[A-Za-z0-9_%/=]|^[.,][0-9]')",
        "more_before": f"int({before} rlike '[0-9][ ().\\\\-/]{{1,2}}$') + int({before} rlike '[0-9][-./]$')", "more_after": f"int({after} rlike '^[ ().\\\\-/]{{1,2}}[0-9]') + int({after} rlike '^[-./][0-9]')",
        "said_at": f"int(contains({c}.what, '@')) + 2 * int({c}.what rlike '[(]at[)]|at]')", "said_dot": f"int({c}.what rlike '[.][A-Za-z]{{2,6}}$') + 2 * int({c}.what rlike '[(]dot[)]|dot]| dot ')",
        "n_upper": count("A-Z"), "n_lower": count("a-z"), "hexadecimal": f"int({c}.what rlike '^[0-9a-f]+$')", "assigned": f"int({before} rlike '[:=]\\\\s*[\"\\']?$')",
        "first": f"coalesce(try_cast(substr({_digits(f'{c}.what')}, 1, 1) as int), -1)",
    } | {name: f"int({before} rlike '(?:^|[^a-z])(?:{cue})')" for name, cue in CUES.items()}
    told = ", ".join(f"'{k}', {values[k]}" for k in FEATURES)
    return f"transform(array({near}), w -> named_struct({told}))[0]"


def examples(n: int = EXAMPLES, seed: int = 17) -> list[tuple[str, int, list[tuple[int, int]]]]:
    """(text, kind, spans) by rule: personal data in varied forms and company, and numbers and phrases that look like it, without a span."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice(["an", "er", "tion", "re", "th", "ou", "le", "st", "en"]) for _ in range(r.randint(1, 3)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        check = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(body)))
        return body + str(-check % 10)

    def spaced(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    at, dot = lambda: r.choice([" (at) ", "(at)", "[at]", " [at] ", " at "]), lambda: r.choice([".", " dot ", "(dot)", " [dot] "])
    phone = lambda: r.choice(["(%s) %s-%s", "%s-%s-%s", "%s.%s.%s", "%s %s %s"]) % (r.choice("23456789") + d(2), d(3), d(4))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(of) for _ in range(k))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    named = lambda: r.choice(["password", "Password", "passwd", "pwd", "secret", "token", "api_key", "API-KEY", "access_key", "client_key", "auth_key", "credentials"])
    value = lambda: r.choice([hexes(r.randint(8, 48)), mixed(r.randint(8, 40)), mixed(r.randint(6, 9)) + r.choice("!$%&#") + d(2), w() + d(r.randint(2, 5)) + w()])
    quoted = lambda: (lambda q: f"{q}<{value()}>{q}")(r.choice(["", "", '"', "'"]))
    makers = [
        (3, lambda: f"{r.choice(['call', 'phone', 'tel.', 'mobile:', 'fax', ''])} <{phone()}>"),
        (3, lambda: f"{r.choice(['call', 'tel', 'phone:', w()])} <+{r.choice('123456789')}{r.choice([' ', '-', ''])}{d(3)} {d(3)} {d(4)}>"),
        (3, lambda: f"{r.choice(['call', 'tel', 'phone:', 'Tel:', 'fax', 'mobile is', 'mobile', 'whatsapp', 'dial', 'sms'])} <0{d(r.randint(2, 4))}{r.choice([' ', '-', '/', ' / '])}{r.choice([d(6), d(7), d(8), d(4) + ' ' + d(4), d(3) + ' ' + d(4), d(3) + ' ' + d(3)])}>"),
        (2, lambda: f"{r.choice(['card', 'visa', 'payment with', 'credit card:', w()])} <{spaced(card(), r.choice([' ', '-', '']))}>"),
        (0, lambda: f"{r.choice(['mail', 'contact', 'write to', w()])} <{w()}{r.choice(['.', '_', ''])}{w()}{at()}{w()}{dot()}{r.choice(['com', 'org', 'net', 'de'])}>"),
        (0, lambda: f"{w()} <{w()}@{w()}.{r.choice(['com', 'org'])}>"),
        (1, lambda: f"{r.choice(['host', 'ip', 'server', w()])} <{':'.join('%x' % r.randrange(r.choice([1, 16, 4096, 65536, 65536])) for _ in range(8))}>"),
        (2, lambda: f"{r.choice(['call', 'phone', 'tel.', 'order', w()])} {r.choice(['(%s) %s-%s', '%s-%s-%s']) % (d(3), d(3), d(4))}"),
        (2, lambda: f"{r.choice(['order', 'ref', 'serial', 'id', 'number', 'card', w()])} {d(r.randint(12, 19))}"),
        (3, lambda: f"{r.choice(['order', 'ref', 'serial', 'id', 'card', w()])} {d(r.randint(7, 19))}"),
        (3, lambda: f"{r.choice(['card', 'visa', w()])} {spaced(card(), r.choice([' ', '-', '']))}"),
        (3, lambda: f"{r.choice(['date', 'on', 'time', w()])} 20{d(2)}-{r.choice(['01', '09', '11'])}-{r.choice(['03', '17', '28'])} {d(2)}"),
        (3, lambda: f"{r.choice(['total', 'price', 'version', 'build', w()])} {d(3)}.{d(3)}.{d(3)}"),
        (3, lambda: f"{r.choice(['page', 'isbn', 'ref', w()])} 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        (3, lambda: f"{w()} {d(4)}-{d(4)} {d(2)}/{d(2)}"),
        (3, lambda: f"{w()} {d(1)} {d(2)} {d(3)} {d(2)} {d(1)} {d(2)}"),
        (0, lambda: f"{w()} {w()} at {w()}.{w()} {w()}"),
        (0, lambda: f"{w()} at {w()}{r.choice(['. ', '.', ' .'])}{w().capitalize()}"),
        (0, lambda: f"{w()} at {w()}. {w().capitalize()} {w()}"),
        (0, lambda: f"{w()} at {w()} dot {w()} {w()}"),
        (1, lambda: f"{w()}={':'.join('%02x' % r.randrange(256) for _ in range(8))}"),
        (3, lambda: f"{r.choice(['in', 'since', w()])} {r.choice(['19', '20'])}{d(2)} <{phone()}>"),
        (3, lambda: f"{r.choice(['tel', 'call', 'phone', w()])} <{phone()}>{r.choice([' ', ' / ', '. ', ' - '])}<{phone()}>"),
        (3, lambda: f"{r.choice(['tel', 'call', 'phone', w()])} <{phone()}>{r.choice(['. ', ' ', ' ('])}{d(r.randint(1, 4))}"),
        (3, lambda: f"{r.choice(['tel', 'call', w()])} {r.choice([d(r.randint(1, 5)) + '. ', d(4) + ' ', d(5) + ') '])}<{phone()}>"),
        (2, lambda: f"{r.choice(['card', 'visa', 'payment with', w()])} <{spaced(card(), r.choice([' ', '-', '']))}> {d(2)}{r.choice(['/', '-', ' '])}{d(2)}"),
        (2, lambda: f"{r.choice(['card', 'visa', w()])} {d(r.randint(1, 4))} <{spaced(card(), r.choice([' ', '-', '']))}>{r.choice(['', ' ' + d(3)])}"),
        (2, lambda: f"{r.choice(['card', 'cards', w()])} <{spaced(card(), ' ')}> <{spaced(card(), ' ')}>"),
        (1, lambda: f"{r.choice(['host', 'ip', 'server', w()])} <{r.choice(['fe80', '2001:db8', '2a00:%x' % r.randrange(65536), 'fd%02x' % r.randrange(256)])}::{':'.join('%x' % r.randrange(65536) for _ in range(r.randint(1, 4)))}>"),
        (1, lambda: f"{r.choice(['host', 'ip', 'server', 'login from', w()])} <{':'.join('%x' % r.randrange(256, 65536) for _ in range(r.randint(2, 4)))}::{':'.join('%x' % r.randrange(65536) for _ in range(r.randint(1, 3)))}>"),
        (1, lambda: f"{w()} {r.choice(['add', 'dead', 'face', 'bed', 'a', 'b', 'dec'])}::{r.choice(['add', 'bad', 'fade', 'a', 'c', 'de'])}"),
        (1, lambda: f"{w()} {d(2)}::{d(2)}"),
        (4, lambda: f"{named()}{r.choice(['=', ' = ', ': ', ':', ' is '])}{quoted()}"),
        (4, lambda: f"{named()}{r.choice(['=', ' = ', ': '])}{quoted()}"),
        (4, lambda: f"{r.choice(['key', 'use', w(), 'with', 'bearer'])} <{r.choice(['AKIA', 'ASIA']) + mixed(16, upper)}>"),
        (4, lambda: f"{r.choice(['key', 'use', w(), 'with', 'token'])} <{r.choice(['ghp_', 'gho_', 'glpat-', 'sk-', 'xoxb-', 'npm_'])}{mixed(r.randint(20, 40))}>"),
        (4, lambda: f"{r.choice(['commit', 'sha', 'md5', 'hash', 'digest', 'checksum', 'rev', w()])} {hexes(r.choice([32, 40, 64]))}"),
        (4, lambda: f"{r.choice(['uuid', 'id', 'session', w()])} {hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}"),
        (4, lambda: f"{r.choice(['file', 'img', 'image', w()])} {w()}{r.choice('_-')}20{d(6)}{r.choice('_-')}{d(6)}{r.choice('_-')}{w()}"),
        (4, lambda: f"{r.choice(['the password', 'a token', 'secret', 'the secret', 'passwd'])}{r.choice([' ', ': ', ' is '])}{r.choice(['nothing', 'changed', 'required', 'forgotten', 'needed', 'between', 'invalid', 'expired'])} {w()}"),
        (4, lambda: f"{w()}{w()}{w()}{w()}{w()}{w()}{w()}{d(1)}"),
        (0, lambda: f"{r.choice(['look at', 'see', 'ask', w() + ' at'])} <{w()}{r.choice(['.', '_'])}{w()}{r.choice([' (at) ', '(at)', '[at]', ' [at] '])}{w()}{r.choice(['.', '(dot)', ' [dot] '])}{r.choice(['com', 'org'])}>"),
    ]
    out = []
    for _ in range(n):
        kind, make = r.choice(makers)
        pieces = re.split("[<>]", f"{w()} {w()} {make()}{r.choice([' ', '. ', ', '])}{w()}")
        ends = list(accumulate(map(len, pieces)))
        out.append(("".join(pieces), kind, [(ends[i - 1], ends[i]) for i in range(1, len(pieces), 2)]))
    return out


def grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int) -> tuple | float:
    """A regression tree on gradients: (feature, cut, at most cut, above), or a leaf's value."""
    gain = lambda g, h: g * g / (h + 1.0)
    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            between = (values[:-1] + values[1:]) / 2
            for cut in between if len(between) <= CUTS else between[np.linspace(0, len(between) - 1, CUTS).astype(int)]:
                low = x[:, f] <= cut
                won = gain(slope[low].sum(), curve[low].sum()) + gain(slope[~low].sum(), curve[~low].sum()) - gain(slope.sum(), curve.sum())
                if won > best[0]:
                    best = (won, f, float(cut))
    _, f, cut = best
    if f is None:
        return float(SHRINK * slope.sum() / (curve.sum() + 1.0))
    low = x[:, f] <= cut
    return f, cut, grow(x[low], slope[low], curve[low], depth - 1), grow(x[~low], slope[~low], curve[~low], depth - 1)


def value_of(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, value_of(low, x), value_of(high, x))


def tree_sql(tree: tuple | float, f: str) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    name, cut, low, high = FEATURES[tree[0]], *tree[1:]
    return f"if({f}.{name} <= {cut!r}D, {tree_sql(low, f)}, {tree_sql(high, f)})"


@dataclass(frozen=True)
class Model:
    trees: tuple
    #: The least score that redacts, by kind.
    thresholds: tuple[float, ...]


def chosen_of(score: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which candidates overlap none of their text with a better score; at has text, first and past."""
    taken: dict[int, list[tuple[int, int]]] = {}
    keep = np.zeros(len(score), bool)
    for i in np.lexsort((at[:, 1], at[:, 1] - at[:, 2], -score)):
        text, first, past = (int(v) for v in at[i])
        own = taken.setdefault(text, [])
        if not any(a < past and first < b for a, b in own):
            own.append((first, past))
            keep[i] = True
    return keep


def boost(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> Model:
    """Logistic boosting on two thirds of the texts; a kind's threshold is the least score with enough precision among the chosen of the rest."""
    test = at[:, 0] % 3 == 0
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(x[~test], (y - p)[~test], (p * (1 - p))[~test], DEPTH))
        score += value_of(trees[-1], x)
    test &= chosen_of(score, at)
    thresholds = []
    for kind in range(len(KINDS)):
        own = test & (x[:, 0] == kind)
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], y[own][order]
        precision = np.cumsum(right) / np.arange(1, len(right) + 1)
        good = np.flatnonzero((precision >= PRECISION) & np.r_[s[1:] < s[:-1], True]) if len(s) else np.zeros(0, int)
        thresholds.append(float(s[good[-1]]) if len(good) else float("1e9"))
    return Model(tuple(trees), tuple(thresholds))


@lru_cache(maxsize=1)
def _trained(rows: tuple) -> Model:
    table = np.array(rows, float)
    return boost(table[:, :-4], table[:, -4], table[:, -3:])


def train(spark: SparkSession) -> Model:
    """Trees over the rule-made examples; their features come from the same SQL as the corpus's."""
    made = spark.createDataFrame(examples(), "text string, own int, spans array<struct<first: int, past: int>>").withColumn("c", F.explode(F.expr(candidates_sql("text")))).where("c.kind = own")
    label = F.expr("int(exists(spans, s -> s.first = c.first and s.past = c.past))").alias("label")
    rows = made.select("text", "c", label, F.expr(features_sql("text", "c")).alias("f")).select("f.*", "label", "text", "c.first", "c.past").orderBy("text", "c.first", "c.past").collect()  # EXAMPLES rows, some with several candidates
    place = {text: i for i, text in enumerate(dict.fromkeys(r.text for r in rows))}
    return _trained(tuple((*tuple(r)[:-3], place[r.text], r.first, r.past) for r in rows))


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, piece: int = PIECE) -> DataFrame:
    """Per row: doc_id, base and added, arrays of (first, kind, past, what) in code points, past exclusive; kind is a place in KINDS.

    base has the strict patterns' checked matches; added those candidates that overlap none of these, reach their kind's
    threshold and overlap none with a better score. Null and empty texts have neither. Rows are judged one by one, so repeated rows come out alike.
    Texts are worked on in pieces of about as many characters as piece says, which changes no result.
    """
    model = model or train(documents.sparkSession)
    own = with_blocks(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__own")), "__own", max(piece, BEFORE, AFTER))
    score = " + ".join(tree_sql(t, "f") for t in model.trees)
    least = "array(" + ", ".join(f"{t!r}D" for t in model.thresholds) + ")"
    inside = lambda spans: f"filter({spans}, s -> s.first >= __b.pre and s.past <= __b.pre + __b.size)"
    scored = f"filter(transform({inside(candidates_sql('__masked'))}, c -> transform(array({features_sql('__text', 'c')}), f -> named_struct('order', -({score}), 'chars', c.first - c.past, 'c', c))[0]), s -> -s.order >= element_at({least}, s.c.kind + 1))"
    none = "cast(array() as array<struct<first: int, kind: int, past: int, what: string>>)"
    chosen = f"array_sort(aggregate(array_sort({scored}), {none}, (a, s) -> if(exists(a, b -> b.first < s.c.past and s.c.first < b.past), a, array_append(a, s.c))))"
    placed = lambda spans: f"transform({spans}, s -> named_struct('first', s.first - __b.pre + __b.at, 'kind', s.kind, 'past', s.past - __b.pre + __b.at, 'what', s.what))"
    both = f"named_struct('base', {placed(inside('__base'))}, 'added', {placed(chosen)})"
    for name, value in (("__masked", masked_sql("__text", "__base")), ("__base", base_sql("__text")), ("__text", "__b.text")):
        both = f"transform(array({value}), {name} -> {both})[0]"
    found = own.withColumn("__found", F.expr(f"transform(__blocks, __b -> {both})"))
    return found.select("doc_id", F.expr("flatten(transform(__found, x -> x.base))").alias("base"), F.expr("flatten(transform(__found, x -> x.added))").alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans; spans, all of them as kind:first:past, and n_spans, how many these are."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    told = lambda spans: f"array_join(transform({spans}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.first, s.past)), ',')"
    counts = [F.expr(f"bigint(size(filter(base, s -> s.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(F.expr(told("base")), 256).alias("base_sha256"), F.expr(told("array_sort(concat(base, added))")).alias("spans"), F.expr("bigint(size(base) + size(added))").alias("n_spans"))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: doc_id and text with each run of found characters replaced by its first span's kind in brackets; null stays null."""
    found = find_personal_data(documents.select(F.struct(F.col(id_col), F.col(text_col).cast("string").alias("text")).alias("doc"), F.col(text_col).alias("text")), "doc", "text", model)
    names = "array(" + ", ".join(f"'{k.upper()}'" for k in KINDS) + ")"
    step = f"(a, s) -> if(s.past <= a.at, a, if(s.first < a.at, named_struct('at', s.past, 'out', a.out), named_struct('at', s.past, 'out', concat(a.out, substring(doc_id.text, a.at + 1, s.first - a.at), '[', element_at({names}, s.kind + 1), ']'))))"
    text = F.expr(f"aggregate(array_sort(concat(base, added)), named_struct('at', 0, 'out', ''), {step}, a -> concat(a.out, substring(doc_id.text, a.at + 1)))")
    return found.select(F.col(f"doc_id.{id_col}").alias("doc_id"), text.alias("text"))
