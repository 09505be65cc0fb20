"""Token streams and grammars of JavaScript and TypeScript, with and without JSX, for derivative parsing.

What a slash, a closing brace, an angle bracket or plain text means depends on what the parser expects, so the lexer asks
the state. Line breaks stand for semicolons by the language's own rule: only where the next token does not fit, before a
closing brace, and at the end.
"""

from __future__ import annotations

import re
from functools import lru_cache

from textloom.llm.derive import Grammar

# Words that are never names.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)
# Words that have a meaning in places and are names elsewhere.
CONTEXTUAL = frozenset("let static async await yield of get set as from type interface declare namespace module abstract readonly private protected public override satisfies is keyof infer asserts unique implements accessor require global".split())

# Operators, longest first; ">" always stands alone and is put together by the grammar.
OPERATORS = "=== !== **= ... <<= &&= ||= ??= => == != <= && || ?? ?. ** << ++ -- += -= *= /= %= &= |= ^= + - * / % & | ^ ! ~ < > = ? : ; , . ( ) [ ] { } @".split()

_SPACE = re.compile(r"(?:[^\S\r\n  ]|﻿)+|//[^\n\r  ]*|/\*(?:[^*]|\*(?!/))*\*/|[\r\n  ]+")
_TOKEN = re.compile(
    r"((?:[^\W\d]|[$\\‌‍])(?:[\w$‌‍]|\\u)*)"
    r"|((?:0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[bB][01](?:_?[01])*|0[oO][0-7](?:_?[0-7])*|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?|0\d+)n?(?![\w$]))"
    r"|(\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"
    r"|(`)"
    r"|(#(?:[^\W\d]|[$])[\w$]*)"
    r"|(\?\.(?=\d))"
    r"|(" + "|".join(re.escape(o) for o in OPERATORS) + ")"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\n\r\\/\[]|\\[^\n\r]|\[(?:[^\n\r\\\]]|\\[^\n\r])*\])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
_JSX_TEXT = re.compile(r"[^{}<>]+")
_JSX_OPEN = re.compile(r"<\s*((?:[^\W\d]|[$])[\w$-]*(?:\s*[.:]\s*(?:[^\W\d]|[$])[\w$-]*)*)?")
_JSX_CLOSE = re.compile(r"<\s*/\s*((?:[^\W\d]|[$])[\w$-]*(?:\s*[.:]\s*(?:[^\W\d]|[$])[\w$-]*)*)?\s*>")
_JSX_NAME = re.compile(r"(?:[^\W\d]|[$])[\w$-]*(?::[\w$-]+)?")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")
_JSX_TOKEN = re.compile(r"/\s*>|>|[{=.]")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")

_ANY = " | ".join(f"'{w}'" for w in sorted(RESERVED | CONTEXTUAL))
_NAMES = " | ".join(f"'{w}'" for w in sorted(CONTEXTUAL))


def grammar_text(typed: bool, jsx: bool) -> str:
    t = lambda yes, no="": yes if typed else no
    ann, opt_ann = t("(':' type)?"), t("'?'? (':' type)?")
    targs, tparams = t("typeargs?"), t("typeparams?")
    mods = t("('public' | 'private' | 'protected' | 'readonly' | 'override' | 'static' | 'abstract' | 'declare' | 'accessor')*", "('static' | 'accessor')?")
    return f"""
    program = item* ;
    item = statement | import_ | export_ {t("| decorator+ 'export' 'default'? 'abstract'? class_")} ;
    ident = ID | {_NAMES} ;
    word = ID | {_ANY} ;
    eos = ';' | ASI ;

    import_ = 'import' {t("('type')?")} (STR | clause 'from' STR) (('with') object)? eos ;
    clause = ident (',' (named | '*' 'as' ident))? | named | '*' 'as' ident ;
    named = '{{' (spec (',' spec)* ','?)? '}}' ;
    spec = {t("('type')?")} (word | STR) ('as' (word | STR))? ;
    export_ = 'export' (
        'default' (function | 'async' function | class_ {t("| 'abstract' class_ | interface")} | assign eos)
        | '*' ('as' (word | STR))? 'from' STR (('with') object)? eos | {t("'type'?")} named ('from' STR (('with') object)?)? eos
        | var_ eos | function | 'async' function | decorated
        {t("| typedecl | '=' expr eos | 'as' 'namespace' ident eos | 'import' ident '=' expr eos | 'abstract' class_ | 'declare' declared")} ) ;

    statement = block | ';' | var_ eos | expression eos | 'if' '(' expr ')' statement ('else' statement)?
        | 'for' 'await'? '(' forhead ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' (';' | ASI)?
        | ('continue' | 'break') ident? eos | 'return' (expr? eos | NLSEMI) | 'throw' expr eos | 'with' '(' expr ')' statement
        | 'switch' '(' expr ')' '{{' ('case' expr ':' statement* | 'default' ':' statement*)* '}}'
        | 'try' block (('catch' ('(' binding {ann} ')')? block) ('finally' block)? | 'finally' block)
        | 'debugger' eos | ident ':' statement | function | 'async' function | decorated
        {t("| typedecl | 'abstract' class_ | 'declare' declared | 'import' ident '=' expr eos")} ;
    block = '{{' statement* '}}' ;
    forhead = ('var' | 'let' | 'const') binding {ann} ('of' assign | 'in' expr) | ('var' | 'let' | 'const') vardecls? ';' expr? ';' expr?
        | expr? ';' expr? ';' expr? | postfix ('of' assign | 'in' expr) ;
    var_ = ('var' | 'let' | 'const') vardecls ;
    vardecls = vardecl (',' vardecl)* ;
    vardecl = ident {t("'!'?")} {ann} ('=' assign)? | pattern {ann} ('=' assign)? ;
    binding = ident | pattern ;
    pattern = '{{' (prop_b (',' prop_b)* (',' rest_b?)? | rest_b)? '}}' | '[' (elem_b? ',')* (elem_b | rest_b)? ']' ;
    prop_b = ident ('=' assign)? | propname ':' binding ('=' assign)? ;
    elem_b = binding ('=' assign)? ;
    rest_b = '...' binding ;
    propname = word | STR | NUM | '[' assign ']' ;

    function = 'function' '*'? ident? {tparams} '(' params ')' {t("(':' rettype)?")} (block {t("| eos")}) ;
    params = (param (',' param)* (',' rest_p?)? | rest_p)? ;
    param = decorator* {t("('public' | 'private' | 'protected' | 'readonly' | 'override')*")} (binding | {t("'this'", "ident")}) {opt_ann} ('=' assign)? ;
    rest_p = decorator* '...' binding {ann} ','? ;
    decorated = decorator* {t("'declare'? 'abstract'?")} class_ ;
    decorator = {t("'@' (ident | '(' expr ')') (('.' (word | PRIVATE)) | '(' args ')')*", "NEVERSEEN")} ;
    class_ = 'class' ident? {tparams} ('extends' postfix {targs})? {t("('implements' type (',' type)*)?")} '{{' member* '}}' ;
    member = ';' | 'static' block | decorator* {mods} memberbody ;
    memberbody = ('get' | 'set')? memname {t("('?' | '!')?")} {tparams} '(' params ')' {t("(':' rettype)?")} (block {t("| eos")})
        | 'async'? '*'? memname {t("('?' | '!')?")} {tparams} '(' params ')' {t("(':' rettype)?")} (block {t("| eos")})
        | memname {t("('?' | '!')? (':' type)?")} ('=' assign)? eos
        {t("| '[' ident ':' type ']' ':' type eos")} ;
    memname = propname | PRIVATE ;

    expression = expr ;
    expr = assign (',' assign)* ;
    args = (('...')? assign (',' ('...')? assign)* ','?)? ;
    assign = unary+ postfix ('++' | '--')? tail | postfix (assignop assign | ('++' | '--')? tail) | arrow | 'yield' ('*'? assign)? | PRIVATE 'in' operand tail ;
    assignop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '**=' | '<<=' | '&&=' | '||=' | '??=' | '>' '>' '=' | '>' '>' '>' '=' ;
    unary = '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' {t("| '<' type '>'") if typed and not jsx else ""} ;
    tail = (binop operand {t("| ('as' | 'satisfies') (type | 'const')")})* ('?' assign ':' assign)? ;
    operand = unary* postfix ('++' | '--')? ;
    binop = '||' | '&&' | '??' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '<<' | '+' | '-' | '*' | '/' | '%' | '**' | 'in' | 'instanceof' | '>' '>'? '>'? | '>' '=' ;
    arrow = ('async')? (ident | {tparams} '(' params ')' {t("(':' rettype)?")}) '=>' (block | arrowbody) ;
    arrowbody = assign ;

    postfix = (primary | 'new' new_) link* ;
    new_ = 'new' new_ | '.' word | newbase ('.' (word | PRIVATE) | '[' expr ']' | template)* {targs} ('(' args ')')? ;
    newbase = primary ;
    link = '.' (word | PRIVATE) | '?.' (word | PRIVATE | '[' expr ']' | {targs} '(' args ')' | template) | '[' expr ']' | {targs} '(' args ')' | template {t("| '!' | typeargs")} ;
    primary = ident | NUM | STR | REGEX | template | 'this' | 'null' | 'true' | 'false' | 'super' | object | array | '(' expr ')'
        | function | 'async' function | decorator* class_ | 'import' ('(' args ')' | '.' word) {"| jsx" if jsx else ""} ;
    template = TPL | THEAD expr (TMID expr)* TTAIL ;
    array = '[' (elem? ',')* elem? ']' ;
    elem = ('...')? assign ;
    object = '{{' (prop (',' prop)* ','?)? '}}' ;
    prop = '...' assign | ident ('=' assign)? | propname ':' assign | ('get' | 'set') propname '(' params ')' {t("(':' rettype)?")} block
        | 'async'? '*'? propname {tparams} '(' params ')' {t("(':' rettype)?")} block ;
    """ + (
        """
    jsx = JOPEN """ + targs + """ attr* (JSELF | JGT child* JCLOSE) ;
    attr = JNAME ('=' (STR | '{' assign '}' | jsx))? | '{' '...' assign '}' ;
    child = JTEXT | '{' ('...'? expr)? '}' | jsx ;
    """
        if jsx
        else ""
    ) + (
        """
    typedecl = interface | 'type' ident typeparams? '=' type eos | 'enum' enumbody | 'const' 'enum' enumbody
        | ('namespace' | 'module') (ident ('.' ident)* | STR) '{' item* '}' | 'declare' 'global' '{' item* '}' ;
    declared = var_ eos | function | 'async' function | class_ | 'abstract' class_ | typedecl | ('module') STR eos | 'global' '{' item* '}' ;
    interface = 'interface' ident typeparams? ('extends' type (',' type)*)? typebody ;
    enumbody = ident '{' (enumitem (',' enumitem)* ','?)? '}' ;
    enumitem = (word | STR) ('=' assign)? ;
    typeparams = '<' typeparam (',' typeparam)* ','? '>' ;
    typeparam = ('const' | 'in' | 'out')* ident ('extends' type)? ('=' type)? ;
    typeargs = '<' type (',' type)* '>' ;
    rettype = type | 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this') ;
    type = condless ('extends' condless '?' type ':' type)? | functype ;
    functype = typeparams? '(' params ')' '=>' rettype | 'abstract'? 'new' typeparams? '(' params ')' '=>' type ;
    condless = ('|' | '&')? typeop (('|' | '&') typeop)* ;
    typeop = ('keyof' | 'unique' | 'readonly')* typepost | 'infer' ident ('extends' condless)? ;
    typepost = typeprim ('[' type? ']')* ;
    typeprim = qualified typeargs? | 'typeof' (qualified | 'import' '(' STR ')') typeargs? | 'void' | 'null' | 'true' | 'false' | 'this' | NUM | '-' NUM | STR | typetemplate | typebody | mapped
        | '[' (tupleitem (',' tupleitem)* ','?)? ']' | '(' type ')' | 'import' '(' STR ')' ('.' word)* typeargs? | functype ;
    qualified = ident ('.' word)* ;
    typetemplate = TPL | THEAD type (TMID type)* TTAIL ;
    tupleitem = ('...')? type '?'? | ('...')? ident '?'? ':' type ;
    typebody = '{' (typemember (';' | ',' | ASI)+)* typemember? '}' ;
    typemember = ('readonly' | '+' 'readonly' | '-' 'readonly')? propname '?'? (':' type)? | ('get' | 'set')? propname '?'? typeparams? '(' params ')' (':' rettype)?
        | typeparams? '(' params ')' (':' rettype)? | 'new' typeparams? '(' params ')' (':' type)? | 'readonly'? '[' ident ':' type ']' ':' type ;
    mapped = '{' (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'? '}' ;
    """
        if typed
        else ""
    )


@lru_cache(maxsize=None)
def grammar(lang: str) -> Grammar:
    return Grammar(grammar_text(lang in ("ts", "tsx"), lang in ("jsx", "tsx")))


TEXT, ATTR, TAIL, REGEX, OPEN, FIRST = 1, 2, 4, 8, 16, 32


def _flag(g: Grammar, state: int) -> int:
    flag = g.flags[state]
    if flag is None:
        may = g.takes(state)
        flag = TEXT * ("JTEXT" in may) | ATTR * ("JNAME" in may or "JGT" in may) | TAIL * ("TTAIL" in may) | REGEX * ("REGEX" in may) | OPEN * ("JOPEN" in may)
        g.flags[state] = flag
    return flag


def check(code: str, lang: str) -> tuple[str, int]:
    """``("ok", length)``, ``("failed", place)`` of the token whose derivative is empty, or ``("truncated", length)``."""
    g = grammar(lang)
    if g.full():
        g.clear()
    size, pos = len(code), 0
    if code.startswith("#!"):
        pos = next((i for i, c in enumerate(code) if c in "\r\n"), size)
    state, step, flags = g.start("program"), g.step, g.flags
    table = g.table
    space, token = _SPACE.match, _TOKEN.match
    names: list[str] = []
    line = False
    last = ""

    def feed(kind: str, newline: bool) -> int:
        """The next state, with a semicolon put in where the language says so; 0 if the token fails."""
        nonlocal state
        if newline and (last == "return" and kind != ";" or last in ("break", "continue") and kind not in (";", "}") and "ASI" in g.takes(state) and not step(state, kind)):
            put = step(state, "NLSEMI") or step(state, "ASI")
            if put and (after := step(put, kind)):
                return after
        after = step(state, kind)
        if newline and kind in ("++", "--") and (put := step(state, "ASI")) and (other := step(put, kind)):
            return other
        if not after and (newline or kind == "}"):
            put = step(state, "ASI")
            after = step(put, kind) if put else 0
        if not after and last == ")":  # after do ... while (x)
            put = step(state, "ASI")
            after = step(put, kind) if put and newline else 0
        return after

    while True:
        flag = flags[state]
        if flag is None:
            flag = _flag(g, state)
        if flag & TEXT:
            m = _JSX_TEXT.match(code, pos)
            if m:
                state, pos = step(state, "JTEXT"), m.end()
                if not state:
                    return "failed", m.start()
                continue
            if pos >= size:
                return "truncated", size
            c = code[pos]
            if c == "<":
                if m := _JSX_CLOSE.match(code, pos):
                    name = re.sub(r"\s", "", m.group(1) or "")
                    if not names or names.pop() != name:
                        return "failed", pos
                    after = step(state, "JCLOSE")
                else:
                    m = _JSX_OPEN.match(code, pos)
                    names.append(re.sub(r"\s", "", m.group(1) or ""))
                    after = step(state, "JOPEN")
                if not after:
                    return "failed", pos
                state, pos, last = after, m.end(), "JOPEN"
                continue
            if c != "{":
                return "failed", pos
            state, pos, last = step(state, "{"), pos + 1, "{"
            continue
        while m := space(code, pos):
            c = code[pos]
            if c in "\r\n  " or c == "/" and code[pos + 1] == "*" and "\n" in m.group():
                line = True
            pos = m.end()
        if pos >= size:
            break
        if flag & ATTR and not (flag & REGEX):
            if m := _JSX_NAME.match(code, pos):
                kind = "JNAME"
            elif m := _JSX_STRING.match(code, pos):
                kind = "STR"
            elif m := _JSX_TOKEN.match(code, pos):
                kind = m.group()
                if kind == ">":
                    kind = "JGT"
                elif kind[0] == "/":
                    kind = "JSELF"
                    if names:
                        names.pop()
            else:
                m, kind = token(code, pos), ""
                if m and m.lastindex == 7:
                    kind = m.group()
            after = step(state, kind) if kind else 0
            if not after and kind == "JGT":
                after = step(state, ">")
            if not after:
                return "failed", pos
            state, pos, line, last = after, m.end(), False, kind
            continue
        c = code[pos]
        if c == "}" and flag & TAIL:
            m = _CHUNK.match(code, pos + 1)
            end = m.end()
            if end >= size:
                return "truncated", size
            kind = "TTAIL" if code[end] == "`" else "TMID"
            pos_next = end + (1 if kind == "TTAIL" else 2)
            after = step(state, kind)
            if not after:
                return "failed", pos
            state, pos, line, last = after, pos_next, False, kind
            continue
        if c == "<" and flag & OPEN and not (lang == "tsx" and _GENERIC.match(code, pos)):
            m = _JSX_OPEN.match(code, pos)
            names.append(re.sub(r"\s", "", m.group(1) or ""))
            state, pos, line, last = step(state, "JOPEN"), m.end(), False, "JOPEN"
            continue
        if c == "/" and flag & REGEX:
            m = _REGEX.match(code, pos)
            if m and (after := step(state, "REGEX")):
                state, pos, line, last = after, m.end(), False, "REGEX"
                continue
        m = token(code, pos)
        if m is None:
            if c == "/" and line and (put := step(state, "ASI")) and (m := _REGEX.match(code, pos)) and (after := step(put, "REGEX")):
                state, pos, line, last = after, m.end(), False, "REGEX"
                continue
            if c in "\"'" and "\n" not in code[pos:]:
                return "truncated", pos
            return "failed", pos
        group, kind, end = m.lastindex, m.group(), m.end()
        if group == 1:
            if kind not in RESERVED and kind not in CONTEXTUAL:
                if "\\" in kind and "\\u" not in kind:
                    return "failed", pos
                kind = "ID"
        elif group == 2:
            if kind[0] == "0" and kind[1:2].isdigit() and lang in ("ts", "tsx"):
                return "failed", pos
            kind = "NUM"
        elif group == 3:
            kind = "STR"
        elif group == 4:
            m = _CHUNK.match(code, end)
            end = m.end()
            if end >= size:
                return "truncated", size
            kind = "TPL" if code[end] == "`" else "THEAD"
            end += 1 if kind == "TPL" else 2
        elif group == 5:
            kind = "PRIVATE"
        elif group == 6:
            kind, end = "?", pos + 1
        if not line and kind not in ("}", "++", "--") and (after := table[state].get(kind)):
            pass
        else:
            after = feed(kind, line)
            if not after:
                return "failed", pos
        state, pos, line, last = after, end, False, kind
        table = g.table
    if names:
        return "truncated", size
    if g.ends(state):
        return "ok", size
    for put in ("ASI", "NLSEMI"):
        after = step(state, put)
        if after and g.ends(after):
            return "ok", size
    return "truncated", size
