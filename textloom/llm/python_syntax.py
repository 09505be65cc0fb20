"""Token streams and the grammar of Python 3.13 for derivative parsing."""

from __future__ import annotations

import re
from functools import lru_cache

from textloom.llm.derive import Grammar

# The language's keywords, and those that are names elsewhere.
KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = frozenset("match case type _".split())
OPERATORS = "**= //= >>= <<= ... != -> := == <= >= += -= *= /= %= &= |= ^= @= ** // << >> ( ) [ ] { } , : . ; + - * / % @ & | ^ ~ < > =".split()

GRAMMAR = """
file = statement* ;
statement = simple | compound ;
simple = small (';' small)* ';'? NEWLINE ;
small = exprs_ | assignment | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' name (',' name)* | 'nonlocal' name (',' name)*
    | 'del' deltarget (',' deltarget)* ','? | 'assert' expr (',' expr)? | import_ | 'type' name tparams? '=' expr | yield_ ;
name = ID | 'match' | 'case' | 'type' | '_' ;
exprs_ = stars ;
assignment = (targets '=')+ (yield_ | stars) | single augop (yield_ | stars) | annotated ':' expr ('=' (yield_ | stars))? ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' | '@=' ;
import_ = 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' ('.' | '...')* (dotted | ('.' | '...')) 'import' ('*' | impname (',' impname)* | '(' impname (',' impname)* ','? ')') ;
dotted = name ('.' name)* ;
impname = name ('as' name)? ;

targets = startarget (',' startarget)* ','? ;
startarget = '*'? target ;
target = name | atom trailer* place | '(' (startarget (',' startarget)* ','?)? ')' | '[' (startarget (',' startarget)* ','?)? ']' ;
place = '.' name | '[' subs ']' ;
single = name | atom trailer* place | '(' single ')' ;
annotated = name | atom trailer* place | '(' single ')' ;
deltarget = name | atom trailer* place | '(' (deltarget (',' deltarget)* ','?)? ')' | '[' (deltarget (',' deltarget)* ','?)? ']' ;

compound = if_ | while_ | for_ | try_ | with_ | def_ | class_ | match_ | ('@' named NEWLINE)+ (def_ | class_ | 'async' def_) | 'async' (def_ | for_ | with_) ;
block = NEWLINE INDENT statement+ DEDENT | simple ;
if_ = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? ;
while_ = 'while' named ':' block ('else' ':' block)? ;
for_ = 'for' targets 'in' stars ':' block ('else' ':' block)? ;
try_ = 'try' ':' block (except_+ ('else' ':' block)? ('finally' ':' block)? | group_+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) ;
except_ = 'except' (expr ('as' name)?)? ':' block ;
group_ = 'except' '*' expr ('as' name)? ':' block ;
with_ = 'with' (withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')') ':' block ;
withitem = expr ('as' startarget)? ;
def_ = 'def' name tparams? '(' params? ')' ('->' expr)? ':' block ;
class_ = 'class' name tparams? ('(' args? ')')? ':' block ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = name (':' expr)? ('=' expr)? | '*' name ('=' expr)? | '**' name ('=' expr)? ;
params = bare ((',' bare)* (',' dflt)*) (',' starpart)? ','? | dflt (',' dflt)* (',' starpart)? ','? | starpart ','? ;
bare = name (':' expr)? | '/' ;
dflt = name (':' expr)? '=' expr | '/' ;
starpart = ('*' (name (':' ('*'? expr))? (',' kwonly)* | (',' kwonly)+)) (',' '**' name (':' expr)?)? | '**' name (':' expr)? ;
kwonly = name (':' expr)? ('=' expr)? ;
lparams = lbare ((',' lbare)* (',' ldflt)*) (',' lstar)? ','? | ldflt (',' ldflt)* (',' lstar)? ','? | lstar ','? ;
lbare = name | '/' ;
ldflt = name '=' expr | '/' ;
lstar = ('*' (name (',' lkw)* | (',' lkw)+)) (',' '**' name)? | '**' name ;
lkw = name ('=' expr)? ;

match_ = 'match' stars ':' NEWLINE INDENT case_+ DEDENT ;
case_ = 'case' patterns ('if' named)? ':' block ;
patterns = pat (',' pat)* ','? ;
pat = '*' name | orpat ('as' name)? ;
orpat = closed ('|' closed)* ;
closed = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' (patarg (',' patarg)* ','?)? ')')? | '(' (pat (',' pat)* ','?)? ')' | '[' (pat (',' pat)* ','?)? ']'
    | '{' (mapitem (',' mapitem)* ','?)? '}' ;
patarg = pat | name '=' pat ;
mapitem = ('-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | name '.' dotted) ':' pat | '**' name ;

stars = starexpr (',' starexpr)* ','? ;
starexpr = '*' arith | expr ;
starnamed = '*' arith | named ;
named = name ':=' expr | expr ;
yield_ = 'yield' ('from' expr | stars)? ;
expr = logic ('if' logic 'else' expr)? | 'lambda' lparams? ':' expr ;
logic = negated (('and' | 'or') negated)* ;
negated = 'not'* compare ;
compare = arith (cmpop arith)* ;
cmpop = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'not'? 'in' | 'is' 'not'? ;
arith = unary* power (aop unary* power)* ;
unary = '+' | '-' | '~' ;
aop = '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**' ;
power = 'await'? atom trailer* ;
trailer = '.' name | '(' args? ')' | '[' subs ']' ;
subs = sub (',' sub)* ','? ;
sub = named | '*' arith | expr? ':' expr? (':' expr?)? ;
args = arga (',' arga)* (',' argb)* (',' argc)* ','? | argb (',' argb)* (',' argc)* ','? | argc (',' argc)* ','? | named comp ;
arga = named | '*' expr ;
argb = name '=' expr | '*' expr ;
argc = name '=' expr | '**' expr ;
atom = name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (yield_ | starnamed (',' starnamed)* ','? | named comp)? ')' | '[' (starnamed (',' starnamed)* ','? | named comp)? ']'
    | '{' (pair (',' pair)* ','? | expr ':' expr comp | starnamed (',' starnamed)* ','? | named comp)? '}' ;
pair = expr ':' expr | '**' arith ;
comp = ('async'? 'for' targets 'in' logic ('if' (logic | name ':=' logic))*)+ ;
hole = (yield_ | stars) '='? ;
"""

_TOKEN = re.compile(
    r"([^\W\d]\w*+(?![\"'])|[^\W\d]\w{2,}+|(?:in|is|if|or|as)(?=[\"']))"
    r"|(0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|(?:0(?:_?0)*|[1-9](?:_?\d)*))"
    r"|([A-Za-z]{0,2})(\"\"\"|'''|\"|')"
    r"|(" + "|".join(re.escape(o) for o in OPERATORS) + ")"
)
_BLANK = re.compile(r"[ \t\f]*(?:#[^\n\r]*)?(?=[\n\r]|\Z)")
_SPACE = re.compile(r"[ \t\f]+|\\(?:\r\n|\n|\r)|#[^\n\r]*")
_LOOSE = re.compile(r"[ \t\f\n\r]+|#[^\n\r]*|\\(?:\r\n|\n|\r)")
_CONVERSION = re.compile(r"!\s*[rsa]\s*(?=[:}])")
_INDENT = re.compile(r"[ \t\f]*")
_BREAK = re.compile(r"\r\n|\n|\r")
_BODY = {
    '"': re.compile(r"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\""), "'": re.compile(r"(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'"),
    '"""': re.compile(r"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\""), "'''": re.compile(r"(?:[^'\\]|\\[\s\S]|'(?!''))*'''"),
}
_PREFIXES = frozenset("|r|b|u|f|br|rb|fr|rf".split("|"))
_AFTER_NUMBER = re.compile(r"\w+")
_MAY_FOLLOW = frozenset("and or in is if else for not".split())


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar(GRAMMAR)


class _Broken(Exception):
    def __init__(self, place: int, truncated: bool = False):
        self.place, self.truncated = place, truncated


def _string(code: str, pos: int, prefix: str, quote: str) -> int:
    """The end of the string whose quote ends at ``pos``."""
    low = prefix.lower()
    if low not in _PREFIXES:
        raise _Broken(pos)
    if "f" in low:
        return _fstring(code, pos, quote, "r" in low)
    m = _BODY[quote].match(code, pos)
    if m is None:
        raise _Broken(pos, truncated=len(quote) == 3 or not _BREAK.search(code, pos))
    if "b" in low and not m.group().isascii():
        raise _Broken(pos)
    return m.end()


def _fstring(code: str, pos: int, quote: str, raw: bool, spec: bool = False) -> int:
    """The end of a formatted string, its fields parsed; with ``spec``, of a format that ends before a brace."""
    size, single = len(code), len(quote) == 1
    while pos < size:
        c = code[pos]
        if code.startswith(quote, pos):
            if spec:
                raise _Broken(pos)
            return pos + len(quote)
        if c == "\\" and not (raw and code[pos + 1 : pos + 2] in "{}"):
            if code.startswith("\\N{", pos) and not raw:
                pos = code.find("}", pos) + 1 or size
            else:
                pos += 1 if code[pos + 1 : pos + 2] in "{}" else 2
        elif c in "\n\r" and single:
            raise _Broken(pos)
        elif c == "{":
            if code[pos + 1 : pos + 2] == "{" and not spec:
                pos += 2
            else:
                pos = _field(code, pos + 1, quote, raw)
        elif c == "}":
            if spec:
                return pos
            if code[pos + 1 : pos + 2] != "}":
                raise _Broken(pos)
            pos += 2
        else:
            pos += 1
    raise _Broken(size, truncated=True)


def _field(code: str, pos: int, quote: str, raw: bool) -> int:
    """The end of a replacement field that begins after its brace at ``pos``."""
    g = grammar()
    state, depth, size = g.start("hole"), 0, len(code)
    while True:
        while pos < size and (m := _LOOSE.match(code, pos)):
            pos = m.end()
        if pos >= size:
            raise _Broken(size, truncated=True)
        c = code[pos]
        if depth == 0 and (c == "}" or c == "!" and code[pos + 1 : pos + 2] != "=" or c == ":"):
            break
        kind, end = _token(code, pos)
        depth += (kind in ("(", "[", "{")) - (kind in (")", "]", "}"))
        state = g.step(state, kind)
        if not state:
            raise _Broken(pos)
        pos = end
    if not g.ends(state):
        raise _Broken(pos)
    if c == "!":
        m = _CONVERSION.match(code, pos)
        if m is None:
            raise _Broken(pos)
        pos = m.end()
    if code[pos] == ":":
        pos = _fstring(code, pos + 1, quote, raw, spec=True)
    return pos + 1


def _token(code: str, pos: int) -> tuple[str, int]:
    m = _TOKEN.match(code, pos)
    if m is None:
        raise _Broken(pos)
    group, end = m.lastindex, m.end()
    if group == 1:
        word = m.group()
        return (word if word in KEYWORDS or word in SOFT else "ID"), end
    if group == 5:
        return m.group(), end
    if group == 2:
        after = _AFTER_NUMBER.match(code, end)
        if after and after.group() not in _MAY_FOLLOW:
            raise _Broken(pos)
        return "NUM", end
    return "STR", _string(code, end, m.group(3), m.group(4))


def check(code: str) -> tuple[str, int]:
    """``("ok", length)``, ``("failed", place)`` of the token whose derivative is empty, or ``("truncated", length)``."""
    try:
        return _check(code)
    except _Broken as broken:
        return ("truncated" if broken.truncated else "failed"), broken.place
    except RecursionError:  # formatted strings nested beyond all measure
        return "failed", 0


def _check(code: str) -> tuple[str, int]:
    g = grammar()
    if g.full():
        g.clear()
    size, pos = len(code), 1 if code.startswith("﻿") else 0
    if "\0" in code:
        raise _Broken(code.index("\0"))
    state, step = g.start("file"), g.step
    indents, alternates, depth = [0], [0], 0
    token, space = _TOKEN.match, _SPACE.match
    fresh = True
    while True:
        if fresh:  # a new logical line: blank lines do not count
            while (m := _BLANK.match(code, pos)) and m.end() < size:
                pos = _BREAK.match(code, m.end()).end()
            if m or pos >= size:
                break
            m = _INDENT.match(code, pos)
            column = alternate = 0
            for c in m.group():
                if c == "\t":
                    column, alternate = (column // 8 + 1) * 8, alternate + 1
                elif c == "\f":
                    column = alternate = 0
                else:
                    column, alternate = column + 1, alternate + 1
            pos = m.end()
            if code.startswith("\\", pos):
                m = space(code, pos)
                if m is None:
                    raise _Broken(pos)
            if column == indents[-1]:
                if alternate != alternates[-1]:
                    raise _Broken(pos)
            elif column > indents[-1]:
                if alternate <= alternates[-1]:
                    raise _Broken(pos)
                indents.append(column)
                alternates.append(alternate)
                state = step(state, "INDENT")
                if not state:
                    raise _Broken(pos)
            else:
                while column < indents[-1]:
                    indents.pop()
                    alternates.pop()
                    state = step(state, "DEDENT")
                    if not state:
                        raise _Broken(pos)
                if column != indents[-1] or alternate != alternates[-1]:
                    raise _Broken(pos)
            fresh = False
        while m := space(code, pos):
            pos = m.end()
        if pos >= size:
            break
        if m := _BREAK.match(code, pos):
            pos = m.end()
            if not depth:
                state = step(state, "NEWLINE")
                if not state:
                    raise _Broken(m.start())
                fresh = True
            continue
        m = token(code, pos)
        if m is None:
            raise _Broken(pos)
        group, end = m.lastindex, m.end()
        if group == 1:
            kind = m.group()
            if kind not in KEYWORDS and kind not in SOFT:
                kind = "ID"
        elif group == 5:
            kind = m.group()
            if kind in "([{":
                depth += 1
            elif kind in ")]}":
                depth -= 1
        elif group == 2:
            after = _AFTER_NUMBER.match(code, end)
            if after and after.group() not in _MAY_FOLLOW:
                raise _Broken(pos)
            kind = "NUM"
        else:
            kind, end = "STR", _string(code, end, m.group(3), m.group(4))
        state = step(state, kind)
        if not state:
            raise _Broken(pos)
        pos = end
    if depth:
        return "truncated", size
    if not fresh:
        state = step(state, "NEWLINE")
        if not state:
            return "truncated", size
    for _ in indents[1:]:
        state = step(state, "DEDENT")
        if not state:
            return "truncated", size
    return ("ok" if g.ends(state) else "truncated"), size
