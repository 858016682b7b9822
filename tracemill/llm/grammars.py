"""Token streams and grammars of Python 3, ECMAScript modules and TypeScript."""

from __future__ import annotations

import functools
import re
import unicodedata

from .derivatives import Grammar

ERROR = ("ERROR", False)

# --- Python

PYTHON_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PYTHON_SOFT = frozenset("match case type".split())

_PY = re.compile(
    r"""(?P<space>[ \t\f]+|\\\r?\n)
    |(?P<comment>\#[^\r\n]*)
    |(?P<newline>\r\n|\r|\n)
    |(?P<fstring>(?:[fFtT][rR]?|[rR][fFtT])(?:\"{3}|'{3}|"|'))
    |(?P<string>(?:[uU]|[bB][rR]?|[rR][bB]?)?(?:\"{3}(?:[^\\"]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^\\']|\\[\s\S]|'(?!''))*'{3}|"(?:[^"\\\r\n]|\\\r\n|\\[\s\S])*"|'(?:[^'\\\r\n]|\\\r\n|\\[\s\S])*'))
    |(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[0-9](?:_?[0-9])*)?\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*\.?)(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?))
    |(?P<name>[^\W\d][\w\U000e0100-\U000e01ef]*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|>>|<<|<=|>=|==|[-+*/%@&|^~<>()\[\]{},:.;=])
    |(?P<bang>!(?=[sra]\b))
    """,
    re.X,
)
_LEADING_ZERO = re.compile(r"0[0-9_]*[1-9][0-9_]*$")


class _Open:
    """An f-string, or the format of one of its fields, that is being read.

    field: the number of brackets open where its replacement field began, or None in the literal part.
    """

    __slots__ = ("quote", "raw", "above", "spec", "field")

    def __init__(self, quote, raw, above, spec):
        self.quote, self.raw, self.above, self.spec, self.field = quote, raw, above, spec, None


def _literal(source: str, pos: int, quote: str, raw: bool, spec: bool) -> tuple[int, str]:
    """Where the literal part of an f-string (or of a format) that starts at pos ends, and what ends it: {, }, the quote, or "" for an error."""
    n = len(source)
    while pos < n:
        c = source[pos]
        if c == "\\":
            if not raw and source.startswith("N{", pos + 1):
                pos = source.find("}", pos) + 1
                if not pos:
                    return n, ""
            elif source[pos + 1 : pos + 2] in ("{", "}"):
                pos += 1
            elif not raw and not _ESCAPE.match(source, pos):
                return pos, ""
            else:
                pos += 3 if source.startswith("\r\n", pos + 1) else 2
        elif c == "{":
            if not spec and source.startswith("{", pos + 1):
                pos += 2
            else:
                return pos + 1, "{"
        elif c == "}":
            if spec:
                return pos + 1, "}"
            if not source.startswith("}", pos + 1):
                return pos, ""
            pos += 2
        elif c == quote[0] and source.startswith(quote, pos):
            return pos + len(quote), "" if spec else quote
        elif c in "\r\n" and len(quote) == 1:
            return pos, ""
        else:
            pos += 1
    return n, ""


_ESCAPE = re.compile(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{[^}]+\}|[^xuUN])", re.S)
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*(?!\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U(?:000[0-9a-fA-F]|0010)[0-9a-fA-F]{4}|N\{[^}]+\}))\\[xuUN]")
_BAD_BYTE_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![0-9a-fA-F]{2})")
_CLOSES = {"(": ")", "[": "]", "{": "}"}


def python_tokens(source: str):
    """Kinds of a Python source; ERROR ends the stream where no token can be read."""
    if source.startswith("\ufeff"):
        source = source[1:]
    if "\0" in source:
        yield ERROR
        return
    pos, n, brackets, indents, fresh = 0, len(source), [], [(0, 0)], True
    some = False
    fstring: _Open | None = None
    match = _PY.match
    while pos < n:
        if fstring is not None and fstring.field is None:
            pos, ended = _literal(source, pos, fstring.quote, fstring.raw, fstring.spec)
            if ended == "":
                # an f-string that the text ends in is no failing token, only an early end
                if pos < n:
                    yield ERROR
                return
            if ended == "{":
                yield "{", False
                fstring.field = len(brackets)
                brackets.append("{")
            elif ended == "}":
                fstring = fstring.above
                brackets.pop()
                yield "}", False
                fstring.field = None
            else:
                fstring = fstring.above
                yield "FEND", False
            continue
        if fresh:
            # column with tabs at multiples of eight, and with tabs as one: both must agree on the order of lines
            column, narrow, start = 0, 0, pos
            while pos < n and source[pos] in " \t\f":
                c = source[pos]
                column = column + 1 if c == " " else (column // 8 + 1) * 8 if c == "\t" else 0
                narrow = 0 if c == "\f" else narrow + 1
                pos += 1
            if pos < n and source[pos] not in "#\r\n" and not _CONTINUED.match(source, pos):
                if column == indents[-1][0]:
                    if narrow != indents[-1][1]:
                        yield ERROR
                        return
                elif column > indents[-1][0]:
                    if narrow <= indents[-1][1]:
                        yield ERROR
                        return
                    indents.append((column, narrow))
                    yield "INDENT", False
                else:
                    while column < indents[-1][0]:
                        indents.pop()
                        yield "DEDENT", False
                    if (column, narrow) != indents[-1]:
                        yield ERROR
                        return
            fresh = False
            if pos > start:
                continue
        m = match(source, pos)
        if m is None:
            yield ERROR
            return
        group = m.lastgroup
        at, pos = pos, m.end()
        if group == "name":
            word = m.group()
            some = True
            if not word.isascii() and not unicodedata.normalize("NFKC", word).isidentifier():
                yield ERROR
                return
            yield (word if word in PYTHON_KEYWORDS or word in PYTHON_SOFT else "NAME"), False
        elif group == "op":
            word = m.group()
            some = True
            if fstring is not None and len(brackets) == fstring.field + 1:
                if word[0] == ":":
                    # a format follows, read as literal text with fields of its own
                    pos = at + 1
                    fstring = _Open(fstring.quote, fstring.raw, fstring, True)
                    yield "FORMAT", False
                    continue
                if word == "}":
                    brackets.pop()
                    fstring.field = None
                    yield "}", False
                    continue
            if word in _CLOSES:
                brackets.append(word)
            elif word in (")", "]", "}"):
                if not brackets or _CLOSES[brackets.pop()] != word:
                    yield ERROR
                    return
            yield word, False
        elif group == "bang":
            if fstring is None or len(brackets) != fstring.field + 1:
                yield ERROR
                return
            yield "CONVERSION", False
        elif group == "newline":
            if not brackets:
                fresh = True
                if some:
                    some = False
                    yield "NEWLINE", False
        elif group == "fstring":
            some = True
            word = m.group()
            fstring = _Open(word.lstrip("fFtTrR"), "r" in word.lower(), fstring, False)
            yield "FSTART", False
        elif group == "string":
            some = True
            word = m.group()
            head = word[: min(word.find('"') % (n + 1), word.find("'") % (n + 1))].lower()
            if "b" in head:
                if not word.isascii() or ("r" not in head and "\\x" in word and _BAD_BYTE_ESCAPE.search(word)):
                    yield ERROR
                    return
                yield "BYTES", False
                continue
            if "r" not in head and "\\" in word and _BAD_ESCAPE.search(word):
                yield ERROR
                return
            yield "STRING", False
        elif group == "number":
            some = True
            word = m.group()
            if _LEADING_ZERO.match(word) or (pos < n and (source[pos].isalnum() or source[pos] == "_") and not _PY_AFTER_NUMBER.match(source, pos)):
                yield ERROR
                return
            yield ("COMPLEX" if word[-1] in "jJ" else "NUMBER"), False
        elif group == "space" and m.group()[0] == "\\" and pos >= n:
            return
    if brackets or fstring is not None:
        return
    if some:
        yield "NEWLINE", False
    for _ in indents[1:]:
        yield "DEDENT", False


_PY_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")
_CONTINUED = re.compile(r"\\\r?\n")


PYTHON = """
file = {statement} ;
statement = simple | compound ;
simple = small {';' small} [';'] NEWLINE ;
small = assignment | 'pass' | 'break' | 'continue' | 'return' [starexprs] | 'raise' [expr ['from' expr]] | 'global' names | 'nonlocal' names
      | 'del' deltarget {',' deltarget} [','] | 'assert' expr [',' expr] | importing | yielding | 'type' name [typeparams] '=' expr ;
names = name {',' name} ;
name = NAME | 'match' | 'case' | 'type' ;
importing = 'import' dotted ['as' name] {',' dotted ['as' name]}
          | 'from' ({'.' | '...'} dotted | ('.' | '...') {'.' | '...'}) 'import' ('*' | imported | '(' imported [','] ')') ;
imported = name ['as' name] {',' name ['as' name]} ;
dotted = name {'.' name} ;
assignment = starexprs | targets '=' {targets '='} (starexprs | yielding) | single (':' expr ['=' (starexprs | yielding)] | AUGMENT (starexprs | yielding)) ;
targets = startarget {',' startarget} [','] ;
startarget = ['*'] target ;
target = access | name | '(' target ')' | '(' [startarget ',' [targets]] ')' | '[' [targets] ']' ;
single = access | name | '(' single ')' ;
deltarget = access | name | '(' [deltarget {',' deltarget} [',']] ')' | '[' [deltarget {',' deltarget} [',']] ']' ;
access = atom {trailer} ('.' name | '[' subscripts ']') ;
trailer = '.' name | '(' [arguments] ')' | '[' subscripts ']' ;
starexprs = starexpr {',' starexpr} [','] ;
starexpr = '*' bitor | expr ;
items = item {',' item} [','] ;
item = '*' bitor | named ;
named = name ':=' expr | expr ;
yielding = 'yield' ['from' expr | starexprs] ;
expr = disjunction ['if' disjunction 'else' expr] | lambda ;
lambda = 'lambda' [lambdaparams] ':' expr ;
disjunction = inversion {('and' | 'or') inversion} ;
inversion = {'not'} comparison ;
comparison = bitor {compare bitor} ;
compare = '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' ['not'] ;
bitor = factor {binary factor} ;
binary = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ;
factor = {'+' | '-' | '~'} ['await'] atom {trailer} ['**' factor] ;
atom = name | 'True' | 'False' | 'None' | NUMBER | COMPLEX | strings | '...' | group | list | braces ;
strings = text {text} | BYTES {BYTES} ;
text = STRING | FSTART {field} FEND ;
field = '{' (yielding | starexprs) ['='] [CONVERSION name] [FORMAT {field}] '}' ;
group = '(' [yielding | named [comp] | item ',' [items]] ')' ;
list = '[' [items | named comp] ']' ;
braces = '{' [items | named comp | pair {',' pair} [','] | expr ':' expr comp] '}' ;
pair = expr ':' expr | '**' bitor ;
comp = compfor {compfor | 'if' disjunction} ;
compfor = ['async'] 'for' targets 'in' disjunction ;
arguments = positional {',' positional} [',' keywords] [','] | keywords [','] | named comp ;
positional = named | '*' expr ;
keywords = kw {',' kw} [',' dkw {',' dkw}] | dkw {',' dkw} ;
kw = name '=' expr | '*' expr ;
dkw = name '=' expr | '**' expr ;
subscripts = subscript {',' subscript} [','] ;
subscript = named | '*' bitor | [expr] ':' [expr] [':' [expr]] ;
compound = function | conditional | class | with | for | try | while | matching ;
block = NEWLINE INDENT statement {statement} DEDENT | simple ;
decorators = '@' named NEWLINE {'@' named NEWLINE} ;
function = [decorators] ['async'] 'def' name [typeparams] '(' [params [',']] ')' ['->' expr] ':' block ;
typeparams = '[' typeparam {',' typeparam} [','] ']' ;
typeparam = name [':' expr] ['=' expr] | '*' name ['=' starexpr] | '**' name ['=' expr] ;
params = req [',' '/' [',' req]] [',' def] [',' rest] | req ',' def ',' '/' [',' def] [',' rest] | def [',' '/' [',' def]] [',' rest] | rest ;
req = required {',' required} ;
def = defaulted {',' defaulted} ;
required = name [':' expr] ;
defaulted = name [':' expr] '=' expr ;
rest = '*' (name [':' starexpr] {',' keyonly} | ',' keyonly {',' keyonly}) [',' '**' required] | '**' required ;
keyonly = required | defaulted ;
lambdaparams = lparams [','] ;
lparams = names_l [',' '/' [',' names_l]] [',' ldef] [',' lrest] | names_l ',' ldef ',' '/' [',' ldef] [',' lrest] | ldef [',' '/' [',' ldef]] [',' lrest] | lrest ;
names_l = name {',' name} ;
ldef = ldefaulted {',' ldefaulted} ;
ldefaulted = name '=' expr ;
lrest = '*' (name {',' lkeyonly} | ',' lkeyonly {',' lkeyonly}) [',' '**' name] | '**' name ;
lkeyonly = name ['=' expr] ;
conditional = 'if' named ':' block {'elif' named ':' block} ['else' ':' block] ;
while = 'while' named ':' block ['else' ':' block] ;
for = ['async'] 'for' targets 'in' starexprs ':' block ['else' ':' block] ;
class = [decorators] 'class' name [typeparams] ['(' [arguments] ')'] ':' block ;
with = ['async'] 'with' (withitem {',' withitem} | '(' withitem {',' withitem} [','] ')') ':' block ;
withitem = expr ['as' startarget] ;
try = 'try' ':' block (handlers ['else' ':' block] ['finally' ':' block] | 'finally' ':' block) ;
handlers = handler {handler} | starhandler {starhandler} ;
handler = 'except' [expr ['as' name]] ':' block ;
starhandler = 'except' '*' expr ['as' name] ':' block ;
matching = 'match' (named | item ',' [items]) ':' NEWLINE INDENT case {case} DEDENT ;
case = 'case' (aspattern | starpattern ',' [sequence]) ['if' named] ':' block ;
sequence = starpattern {',' starpattern} [','] ;
starpattern = '*' name | aspattern ;
aspattern = closed {'|' closed} ['as' name] ;
closed = ['-'] (NUMBER | COMPLEX) | ['-'] NUMBER ('+' | '-') COMPLEX | strings | 'None' | 'True' | 'False' | dotted ['(' [patternargs [',']] ')'] | '(' [aspattern | starpattern ',' [sequence]] ')' | '[' [sequence] ']' | '{' [mapping [',']] '}' ;
patternargs = aspattern {',' aspattern} {',' name '=' aspattern} | name '=' aspattern {',' name '=' aspattern} ;
mapping = entry {',' entry} [',' '**' name] | '**' name ;
entry = (['-'] (NUMBER | COMPLEX) | ['-'] NUMBER ('+' | '-') COMPLEX | strings | 'None' | 'True' | 'False' | name '.' dotted) ':' aspattern ;
"""

_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())


def python_stream(source: str):
    for kind, newline in python_tokens(source):
        yield ("AUGMENT" if kind in _AUGMENTED else kind), newline


# --- ECMAScript and TypeScript

RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
) | frozenset("await yield let static implements interface package private protected public".split())
CONTEXTUAL = frozenset("async of get set from as target meta accessor".split())
TYPE_WORDS = frozenset("type declare namespace module abstract readonly keyof infer is asserts satisfies unique override out global require constructor".split())

_ID = r"(?:[^\W\d]|[$\\‌‍])(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_JS = re.compile(
    r"""(?P<blank>(?:[ \t\v\f ﻿ - 　]+|//[^\r\n  ]*)+)
    |(?P<line>[\r\n  ]+)
    |(?P<comment>/\*(?:[^*]|\*(?!/))*\*/)
    |(?P<name>\#?"""
    + _ID
    + r""")
    |(?P<number>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?[0-9])*)(?:n(?![\w$])|\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)(?![\w$]))
    |(?P<string>"(?:[^"\\\r\n]|\\\r\n|\\[\s\S])*"|'(?:[^'\\\r\n]|\\\r\n|\\[\s\S])*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*%&|^~!<>(){}\[\],:.;?=@/`])
    """,
    re.X,
)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_REGEX = re.compile(r"/(?:[^/\\\[\r\n*]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])*/([a-z]*)(?![\w$])")
_ASSIGN = frozenset("+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_VALUE_END = frozenset(["NAME", "PRIVATE", "NUMBER", "STRING", "REGEX", "TEMPLATE", "TAIL", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"]) | CONTEXTUAL | TYPE_WORDS
_BEFORE_LINE = frozenset("return break continue throw".split())


def script_stream(source: str, typed: bool):
    """(kind, line break before) of a script; ERROR ends the stream where no token can be read."""
    pos, n = 0, len(source)
    if source.startswith("#!"):
        pos = len(source.split("\n", 1)[0])
    prev, newline = "", False
    braces: list[bool] = []  # whether the brace belongs to a template
    parens: list[str] = []
    closed = ""
    match = _JS.match
    while pos < n:
        m = match(source, pos)
        if m is None:
            yield ERROR
            return
        group = m.lastgroup
        pos = m.end()
        if group == "blank":
            continue
        if group == "line":
            newline = True
            continue
        word = m.group()
        if group == "comment":
            newline = newline or "\n" in word
            continue
        if newline and prev in _BEFORE_LINE:
            yield "!", True
        if group == "name":
            if word[0] == "#":
                kind = "PRIVATE"
            elif prev in (".", "?."):
                kind = "NAME"
            elif word in RESERVED or word in CONTEXTUAL or (typed and word in TYPE_WORDS):
                kind = word
            else:
                kind = "NAME"
        elif group == "number":
            kind = "NUMBER"
        elif group == "string":
            kind = "STRING"
        else:
            kind = word
            if word == "(":
                parens.append(prev)
            elif word == ")":
                closed = parens.pop() if parens else ""
            elif word == "{":
                braces.append(False)
            elif word == "}":
                if braces and braces.pop():
                    t = _TEMPLATE.match(source, pos)
                    if t is None:
                        yield ERROR
                        return
                    pos = t.end()
                    kind = "TAIL" if t.group(1) == "`" else "MIDDLE"
                    if kind == "MIDDLE":
                        braces.append(True)
            elif word == "`":
                t = _TEMPLATE.match(source, pos)
                if t is None:
                    yield ERROR
                    return
                pos = t.end()
                kind = "TEMPLATE" if t.group(1) == "`" else "HEAD"
                if kind == "HEAD":
                    braces.append(True)
            elif word == "/":
                if prev not in _VALUE_END or (prev == ")" and closed in ("if", "while", "for")) or (prev == "}" and newline):
                    r = _REGEX.match(source, pos - 1)
                    if r is None or len(set(r.group(1))) != len(r.group(1)) or set(r.group(1)) - set("dgimsuvy") or not _sound_pattern(r.group()):
                        yield ERROR
                        return
                    pos, kind = r.end(), "REGEX"
                elif source.startswith("=", pos):
                    pos, kind = pos + 1, "ASSIGN"
            elif word in _ASSIGN:
                kind = "ASSIGN"
            elif word in ("++", "--"):
                kind = "PREFIX" if newline or prev not in _VALUE_END else word
            elif typed and word in (">>", ">>>"):
                for _ in word[1:]:
                    yield ">", newline
                    newline = False
                kind = ">"
            yield kind, newline
            prev, newline = kind, False
            continue
        yield kind, newline
        prev, newline = kind, False


def _sound_pattern(text: str) -> bool:
    """Whether groups and classes of a regular expression are closed and nothing is repeated that is not there."""
    depth, inside, i, repeatable = 0, False, 1, False
    end = text.rindex("/")
    while i < end:
        c = text[i]
        if c == "\\":
            i += 2
            repeatable = True
            continue
        if inside:
            inside = c != "]"
            repeatable = True
        elif c == "[":
            inside = True
        elif c == "(":
            depth += 1
            repeatable = False
            if text[i + 1 : i + 2] == "?":
                i += 2
                continue
        elif c == ")":
            depth -= 1
            if depth < 0:
                return False
            repeatable = True
        elif c in "*+?":
            if not repeatable:
                return False
            if text[i + 1 : i + 2] == "?":
                i += 1
            repeatable = False
        elif c == "|":
            repeatable = False
        else:
            repeatable = c not in "^"
        i += 1
    return depth == 0 and not inside


_SCRIPT = """
stmts@ = {stmt@} ;
stmt@ = block@ | decl@ | ';' | notdecl@ end | 'if' '(' exprs@ ')' sub@ ['else' sub@]
  | 'for' [AWAITFOR@] '(' forhead@ ')' sub@ | 'while' '(' exprs@ ')' sub@ | 'do' sub@ 'while' '(' exprs@ ')' [';' | ASI]
  | 'continue' [ident] end | 'break' [ident] end | RETURN@ [exprs@] end | 'throw' exprs@ end | 'debugger' end
  | 'switch' '(' exprs@ ')' '{' {'case' exprs@ ':' stmts@ | 'default' ':' stmts@} '}'
  | 'try' block@ ('catch' ['(' binding@ TYPEANN ')'] block@ ['finally' block@] | 'finally' block@) | ident ':' sub@ ;
sub@ = stmt@ ;
block@ = '{' stmts@ '}' ;
decl@ = function@ | class@ | lexical@ end TYPEDECL@ ;
lexical@ = ('let' | 'var') declarator@ {',' declarator@} | 'const' constdecl@ {',' constdecl@} ;
declarator@ = ident DEFINITE TYPEANN ['=' expr@] | pattern@ TYPEANN '=' expr@ ;
constdecl@ = ident TYPEANN '=' expr@ | pattern@ TYPEANN '=' expr@ ;
binding@ = ident | pattern@ ;
pattern@ = '[' {','} [element@ {',' [element@]}] ['...' binding@] ']' | '{' [property@ {',' property@} [',' ['...' ident]] | '...' ident] '}' ;
element@ = binding@ ['=' expr@] | '...' binding@ ;
property@ = ident ['=' expr@] | key@ ':' binding@ ['=' expr@] ;
forhead@ = [lexical@ | notdecl@] ';' [exprs@] ';' [exprs@] | (('let' | 'var' | 'const') binding@ | lhs@) ('of' expr@ | 'in' exprs@) ;
exprs@ = expr@ {',' expr@} ;
notdecl@ = start@ {',' expr@} ;
start@ = startlhs@ ('=' | ASSIGN) expr@ | startcond@ | arrow@ | YIELD@ ;
startlhs@ = startprimary@ {suffix@} ;
startcond@ = startunary@ {binary unary@} ['?' expr@ ':' expr@] ;
startunary@ = AWAIT@ | unop {unop} unary0@ | startprimary@ {suffix@} ['++' | '--' | 'PREFIX'] CASTS ;
expr@ = lhs@ ('=' | ASSIGN) expr@ | cond@ | arrow@ | YIELD@ ;
lhs@ = primary@ {suffix@} ;
cond@ = unary@ {binary unary@} ['?' expr@ ':' expr@] ;
unary@ = {unop} unary0@ ;
unop = 'delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | PREFIX | '++' | '--' ;
unary0@ = AWAIT@ | primary@ {suffix@} ['++' | '--'] CASTS | PRIVATE 'in' unary@ ;
suffix@ = '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' exprs@ ']' | args@ | template@) | '[' exprs@ ']' | args@ | template@ GENERICCALL ;
args@ = '(' [arg@ {',' arg@} [',']] ')' ;
arg@ = ['...'] expr@ ;
binary = '*' | '/' | '%' | '+' | '-' | '<<' | '>>' | '>>>' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '==' | '!=' | '===' | '!==' | '&' | '^' | '|' | '&&' | '||' | '??' | '**' SHIFTS ;
startprimary@ = ident | 'this' | 'super' | literal | '(' exprs@ ')' | array@ | template@ | new@ | 'import' ('(' expr@ [',' [expr@ [',']]] ')' | '.' NAME) ;
primary@ = startprimary@ | object@ | functionexpr@ | classexpr@ ;
literal = 'null' | 'true' | 'false' | NUMBER | STRING | REGEX ;
array@ = '[' {','} [['...'] expr@ {',' [['...'] expr@]}] ']' ;
object@ = '{' [member@ {',' member@} [',']] '}' ;
member@ = ident ['=' expr@] | key@ ':' expr@ | method@ | '...' expr@ ;
key@ = anyname | STRING | NUMBER | '[' expr@ ']' ;
method@ = key@ SIGNATURE '{' stmtsF '}' | '*' key@ SIGNATUREG '{' stmtsG '}' | 'async' key@ SIGNATUREA '{' stmtsA '}' | 'async' '*' key@ SIGNATUREB '{' stmtsB '}' | ('get' | 'set') key@ SIGNATURE '{' stmtsF '}' ;
template@ = TEMPLATE | HEAD exprs@ {MIDDLE exprs@} TAIL ;
new@ = 'new' {'new'} (newtarget@ {'.' (NAME | PRIVATE) | '[' exprs@ ']' | template@} TYPEARGS [args@] | '.' NAME) ;
newtarget@ = ident | 'this' | 'super' | literal | '(' exprs@ ')' | array@ | object@ | functionexpr@ | classexpr@ | template@ | 'import' '.' NAME ;
arrow@ = ident '=>' bodyF@ | ARROWF '=>' bodyF@ | 'async' ident '=>' bodyA@ | 'async' ARROWA '=>' bodyA@ ;
bodyF@ = '{' stmtsF '}' | conciseF ;
bodyA@ = '{' stmtsA '}' | conciseA ;
concise@ = start@ | (functionexpr@ | classexpr@) {suffix@} ;
function@ = 'function' ident SIGNATURE BODYF | 'function' '*' ident SIGNATUREG BODYG | 'async' 'function' ident SIGNATUREA BODYA | 'async' 'function' '*' ident SIGNATUREB BODYB ;
functionexpr@ = 'function' [ident] SIGNATURE '{' stmtsF '}' | 'function' '*' [ident] SIGNATUREG '{' stmtsG '}' | 'async' 'function' [ident] SIGNATUREA '{' stmtsA '}' | 'async' 'function' '*' [ident] SIGNATUREB '{' stmtsB '}' ;
class@ = DECORATORS@ CLASSMOD 'class' ident TYPEPARAMS classtail@ ;
classexpr@ = DECORATORS@ 'class' [ident] TYPEPARAMS classtail@ ;
classtail@ = ['extends' lhs@ TYPEARGS] IMPLEMENTS '{' {classmember@ | ';'} '}' ;
classmember@ = DECORATORS@ MODIFIERS (method@ FIELDS@ | OVERLOADS@ | classkey@ DEFINITE TYPEANN ['=' exprF] end | 'static' '{' stmtsA '}' INDEXSIG) ;
classkey@ = key@ | PRIVATE ;
"""

_COMMON = """
end = ';' | ASI ;
ident = NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'target' | 'meta' | 'accessor' IDENTS ;
modulefile = {item} ;
item = stmtT | 'import' importclause 'from' STRING [attributes] end | 'import' STRING [attributes] end
  | 'export' ('*' ['as' (anyname | STRING)] 'from' STRING [attributes] end | exports ['from' STRING [attributes]] end | declT
    | 'default' (defaultfunction | classdefault | defaultexpr end)) TYPEITEMS ;
attributes = 'with' '{' [attribute {',' attribute} [',']] '}' ;
attribute = (anyname | STRING) ':' STRING ;
importclause = ident [',' (namespace_ | imports)] | namespace_ | imports TYPEIMPORTS ;
namespace_ = '*' 'as' ident ;
imports = '{' [importspec {',' importspec} [',']] '}' ;
importspec = ident | (anyname | STRING) 'as' ident TYPESPEC ;
exports = '{' [exportspec {',' exportspec} [',']] '}' ;
exportspec = (anyname | STRING) ['as' (anyname | STRING)] TYPEEXPORT ;
defaultfunction = 'function' [ident] SIGNATURE BODYF | 'function' '*' [ident] SIGNATUREG BODYG | 'async' 'function' [ident] SIGNATUREA BODYA | 'async' 'function' '*' [ident] SIGNATUREB BODYB ;
classdefault = DECORATORST CLASSMOD 'class' [ident] TYPEPARAMS classtailT ;
defaultexpr = startT_nofunction ;
startT_nofunction = exprT ;
"""

_TYPES = """
typeann = ':' type ;
type = [('asserts' ident | ident | 'this') 'is'] typeunion ['extends' typeunion '?' type ':' type] | 'asserts' ident | functiontype ;
functiontype = ['abstract'] ['new'] [typeparams] '(' [params_t] ')' '=>' type ;
typeunion = ['|' | '&'] typeop {('|' | '&') (typeop | functiontype)} ;
typeop = {'keyof' | 'readonly' | 'unique' | 'infer'} typepostfix ;
typepostfix = typeatom {'[' [type] ']'} ;
typeatom = '(' type ')' | typename ['<' types '>'] | literal_t | TEMPLATE | HEAD type {MIDDLE type} TAIL | 'this' | 'void' | 'null' | 'typeof' (typename | 'import' '(' STRING ')') ['<' types '>'] | '{' {typemember} '}' | '[' [tuple {',' tuple} [',']] ']' | 'import' '(' STRING ')' {'.' NAME} ['<' types '>'] ;
typename = ident {'.' NAME} ;
literal_t = ['-'] NUMBER | STRING | 'true' | 'false' ;
tuple = ['...'] [anyname ['?'] ':'] type ['?'] ;
types = type {',' type} ;
typemember = {modifier_t} (key_t ['?'] (typeann | signature_t) | key_t ['?'] | signature_t | 'new' signature_t | ('get' | 'set') key_t signature_t | '[' ident ':' type ']' typeann | ['+' | '-'] 'readonly' mapped | mapped) [',' | ';' | ASI] ;
mapped = '[' ident 'in' type ['as' type] ']' [['+' | '-'] '?'] [typeann] ;
modifier_t = 'readonly' ;
key_t = anyname | STRING | NUMBER | '[' exprF ']' ;
signature_t = [typeparams] '(' [params_t] ')' [typeann] ;
params_t = param_t {',' param_t} [','] ;
param_t = ['...'] (ident | 'this' | patternF) ['?'] [typeann] ;
typeparams = '<' typeparam {',' typeparam} [','] '>' ;
typeparam = {'const' | 'in' | 'out'} ident ['extends' type] ['=' type] ;
interface = 'interface' ident [typeparams] ['extends' heritage {',' heritage}] '{' {typemember} '}' ;
heritage = typename ['<' types '>'] ;
alias = 'type' ident [typeparams] '=' type end ;
enum = ['const'] 'enum' ident '{' [enummember {',' enummember} [',']] '}' ;
enummember = (anyname | STRING) ['=' exprF] ;
namespace_decl = ('namespace' | 'module') typename '{' {item} '}' ;
ambient = ['export'] ('const' | 'let' | 'var') ident [typeann] {',' ident [typeann]} end ;
ambients = '{' {item | ambient} '}' ;
declare = 'declare' (declT | interface | alias | enum | ('namespace' | 'module') (typename | STRING) ambients | 'global' ambients | 'module' STRING end | ('const' | 'let' | 'var') ident typeann {',' ident typeann} end) ;
"""


def _words(words) -> str:
    return " | ".join(f"'{w}'" for w in sorted(words))


@functools.lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    """The grammar of python, javascript (a module) or typescript."""
    if language == "python":
        return Grammar(PYTHON, "file")
    typed = language == "typescript"
    # contexts: the top of a module (T), functions (F), async ones (A), generators (G), async generators (B)
    text = ""
    for c in "TFAGB":
        waits, yields = c in "TAB", c in "GB"
        part = _SCRIPT.replace("AWAITFOR@", "'await'" if waits else "NONE").replace("RETURN@", "NONE" if c == "T" else "'return'")
        part = part.replace("YIELD@", "'yield' [['*'] expr@]" if yields else "NONE").replace("AWAIT@", "'await' unary@" if waits else "NONE")
        part = part.replace("DECORATORS@", "{'@' decorator@}") + "decorator@ = ident {'.' NAME} [args@] | '(' exprs@ ')' ;\n"
        part += "params@ = param@ {',' param@} [','] ;\n"
        if typed:
            part = part.replace("TYPEDECL@", "| interface | alias | enum | declare | namespace_decl")
            part = part.replace("FIELDS@", "| method_private@").replace("OVERLOADS@", "classkey@ ['?'] SIGNATURE end | classkey@ '?' TYPEANN ['=' exprF] end | classkey@ '?' SIGNATURE '{' stmtsF '}' | ('get' | 'set') classkey@ SIGNATURE end | '[' ident ':' type ']' typeann end")
            part += "param@ = {'@' decorator@} {'public' | 'private' | 'protected' | 'readonly' | 'override'} ['...'] (binding@ | 'this') ['?'] [typeann] ['=' expr@] ;\n"
        else:
            part = part.replace("TYPEDECL@", "").replace("FIELDS@", "| method_private@").replace("OVERLOADS@", "NONE")
            part += "param@ = ['...'] binding@ ['=' expr@] ;\n"
        part += "method_private@ = PRIVATE SIGNATURE '{' stmtsF '}' | '*' PRIVATE SIGNATUREG '{' stmtsG '}' | 'async' PRIVATE SIGNATUREA '{' stmtsA '}' | 'async' '*' PRIVATE SIGNATUREB '{' stmtsB '}' | ('get' | 'set') PRIVATE SIGNATURE '{' stmtsF '}' ;\n"
        text += part.replace("@", c)
    text += _COMMON.replace("DECORATORST", "{'@' decoratorT}")
    text += "anyname = NAME | " + _words(RESERVED | CONTEXTUAL | (TYPE_WORDS if typed else frozenset())) + " ;\n"
    if typed:
        text += _TYPES
    swaps = {
        "TYPEANN": ("[typeann]", ""),
        "DEFINITE": ("['!' | '?']", ""),
        "CASTS": ("{'!' | ('as' | 'satisfies') ('const' | type)}", ""),
        "GENERICCALL": ("| '!' | '<' types '>' (args@ | template@)", ""),
        "SHIFTS": ("| '>' '>' ['>'] | '>' '>='", ""),
        "TYPEARGS": ("['<' types '>']", ""),
        "TYPEPARAMS": ("[typeparams]", ""),
        "CLASSMOD": ("['abstract']", ""),
        "IMPLEMENTS": ("['implements' heritage {',' heritage}]", ""),
        "MODIFIERS": ("{'public' | 'private' | 'protected' | 'static' | 'abstract' | 'readonly' | 'override' | 'declare' | 'accessor'}", "['static']"),
        "INDEXSIG": ("", ""),
        "IDENTS": ("| " + _words(TYPE_WORDS), ""),
        "TYPEITEMS": ("| 'export' ('type' (exports ['from' STRING] end | '*' ['as' anyname] 'from' STRING end) | '=' exprT end | 'default' interface | 'as' 'namespace' ident end) | 'import' ('type' importclause 'from' STRING end | ['type'] ident '=' ('require' '(' STRING ')' | typename) end)", ""),
        "TYPEIMPORTS": ("", ""),
        "TYPESPEC": ("| 'type' (ident | anyname 'as' ident)", ""),
        "TYPEEXPORT": ("| 'type' anyname ['as' anyname]", ""),
        "ARROWF": ("[typeparams] '(' [paramsF] ')' [typeann]", "'(' [paramsF] ')'"),
        "ARROWA": ("[typeparams] '(' [paramsA] ')' [typeann]", "'(' [paramsA] ')'"),
    }
    for c in "FAGB":
        swaps[f"BODY{c}"] = (f"('{{' stmts{c} '}}' | end)", f"'{{' stmts{c} '}}'")
        name = "SIGNATURE" if c == "F" else f"SIGNATURE{c}"
        swaps[name] = (f"[typeparams] '(' [params{c}] ')' [typeann]", f"'(' [params{c}] ')'")
    for word in sorted(swaps, key=len, reverse=True):
        new = swaps[word][0 if typed else 1]
        text = re.sub(rf"(?<![\w'])({word})(?![\w'])", lambda m, new=new: new.replace("@", "F"), text)
    return Grammar(text, "modulefile")


def check(source: str, language: str) -> tuple[str, int]:
    """("valid" | "failed" | "truncated", tokens read) of a source."""
    g = grammar(language)
    g.forget()
    stream = python_stream(source) if language == "python" else script_stream(source, language == "typescript")
    return g.parse(stream)


def line_of(source: str, language: str, tokens: int) -> int:
    """Line, from 1, on which the reading of that many tokens ends."""
    stream = python_tokens(source) if language == "python" else script_stream(source, language == "typescript")
    for _ in range(tokens):
        if next(stream, None) is None:
            break
    pos = stream.gi_frame.f_locals["pos"] if stream.gi_frame is not None else len(source)
    return len(source[:pos].splitlines()) or 1
