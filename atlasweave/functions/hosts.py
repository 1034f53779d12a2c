"""ASCII forms of Unicode host names as SQL expressions (RFC 3492, without any user-defined function).

The published procedure walks the code points of a label over and over. Here each non-basic character is an insertion whose
number follows from the ones sorted before it: characters are inserted by (code point, position), so the text that stands when
one is inserted, its place there, the gap to the insertion before and the bias all come from sorted neighbours. Only the digits
of one number and the scaling of its bias are folds. The expressions are SQL text, which is parsed in one call.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the encoding: digits, thresholds, scaling of the bias, first code point.
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Dots of other scripts, and characters that a host name leaves out.
DOTS = "\u3002\uff0e\uff61"
IGNORED = r"[\u00ad\u034f\u180b-\u180d\u180f\u200b\u2060\u2064\ufe00-\ufe0f\ufeff]"
#: Combining marks and the blocks of compatibility characters.
COMPOSED = r"[\p{M}\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u0132\u0133\u017f\u01c4-\u01cc\u2000-\u2bff\u3200-\u33ff\uf900-\ufdff\ufe20-\ufefe\uff61-\uffef]"
#: Sharp s, final sigma and joiners, which keep their own form.
KEPT = r"[\u00df\u03c2\u200c\u200d]"
BEYOND = r"[^\x00-\x7f]"


def _let(name: str, value: str, then: str) -> str:
    """``then`` with ``name`` standing for ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_POINTS = "transform(split({0}, ''), (c, i) -> named_struct('code', cast(ascii(c) AS BIGINT), 'pos', i))"
#: Insertions in order: the code point, its place in the text that stands just before, and the size of that text.
_INSERTIONS = """transform(array_sort(filter(points, x -> x.code >= 128)), (x, k) -> named_struct('code', x.code,
 'place', cast(size(filter(points, o -> o.pos < x.pos AND o.code <= x.code)) AS BIGINT), 'size', cast(size(filter(points, o -> o.code < 128)) + k AS BIGINT)))"""
#: How far the walk over all (code point, place) goes from one insertion to the next.
_NUMBERS = """transform(found, (x, k) -> named_struct('size', x.size,
 'delta', (x.code - coalesce(get(found, k - 1).code, 128L)) * (x.size + 1) + x.place - coalesce(get(found, k - 1).place + 1, 0L)))"""
#: The bias behind the number before: scaled down, then divided by 35 until it is at most 455 (six times suffice for any label).
_BIAS = "if(k = 0, 72L, " + _let("y", "get(numbers, k - 1).delta div if(k = 1, 700, 2)", """aggregate(sequence(1, 6), named_struct('left', y + y div x.size, 'bias', 0L),
 (s, n) -> if(s.left > 455, named_struct('left', s.left div 35, 'bias', s.bias + 36L), s), s -> s.bias + 36L * s.left div (s.left + 38L))""") + ")"
#: One number in digits of falling weight; a digit below its threshold is the last (24 are more than any label needs).
_ONE = "aggregate(sequence(1, 24), named_struct('q', x.delta, 'out', ''), (s, j) -> if(s.q < 0, s, " + _let("t", "least(greatest(36L * j - bias, 1L), 26L)", f"""if(s.q < t,
 named_struct('q', -1L, 'out', concat(s.out, substring('{DIGITS}', cast(s.q + 1 AS INT), 1))),
 named_struct('q', (s.q - t) div (36L - t), 'out', concat(s.out, substring('{DIGITS}', cast(t + (s.q - t) % (36L - t) + 1 AS INT), 1))))""") + "), s -> s.out)"


def _punycode(label: str) -> str:
    texts = f"array_join(transform(numbers, (x, k) -> {_let('bias', _BIAS, _ONE)}), '')"
    encoded = _let("points", _POINTS.format(label), _let("found", _INSERTIONS, _let("numbers", _NUMBERS, texts)))
    basic = f"regexp_replace({label}, r'{BEYOND}', '')"
    return f"concat({basic}, if({label} rlike r'[\\x00-\\x7f]', '-', ''), {encoded})"


def _mapped(host: str) -> str:
    """Lower case, full-width forms as ASCII, dots of other scripts as dots, ignored characters out; other compatibility
    characters and combining marks in their composed form by the JDK's name preparation where it takes the host."""
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    simple = f"lower(regexp_replace(translate({host}, {_text(wide + DOTS + 'Σ')}, {_text(narrow + '...' + 'σ')}), r'{IGNORED}', ''))"
    # the last argument lets characters newer than the JDK's tables pass
    prepared = "try_reflect('java.net.IDN', 'toUnicode', try_reflect('java.net.IDN', 'toASCII', simple, 1), 1)"
    return _let("simple", simple, f"if(simple rlike r'{COMPOSED}' AND NOT simple rlike r'{KEPT}', coalesce({prepared}, simple), simple)")


def punycode(column: str) -> Column:
    """The Bootstring form of the labels in a column, without the ``xn--`` in front."""
    return F.expr(_punycode(column))


def ascii_host(column: str) -> Column:
    """The hosts in a column with each label that has other than ASCII characters as ``xn--`` and its Bootstring form; ASCII
    hosts and null as they are.

    Sizes are not checked, as in URLs, and a label that is ASCII already stays unread.
    """
    labels = f"split({_mapped(column)}, r'\\.')"
    encoded = f"transform({labels}, label -> if(label rlike r'{BEYOND}', concat('xn--', {_punycode('label')}), label))"
    return F.expr(f"if(octet_length({column}) > char_length({column}), array_join({encoded}, '.'), {column})")
