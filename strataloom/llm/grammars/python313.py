"""Python 3.13: tokens with indentation, and the grammar over them."""

from __future__ import annotations

import re
import unicodedata

from strataloom.llm.grammars import LexError

# The reserved words.
KEYWORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SOFT = {"match", "case", "type", "_"}

GRAMMAR = r"""
file <- (NEWLINE / statement)*
statement <- compound / simple
simple <- small (';' small)* ';'? NEWLINE
small <- 'pass' / 'break' / 'continue' / return / raise / import / 'global' names / 'nonlocal' names / del / assert / type_alias / assignment
return <- 'return' star_list?
raise <- 'raise' (test ('from' test)?)?
del <- 'del' del_target (',' del_target)* ','?
del_target <- single_target / '(' (del_target (',' del_target)* ','?)? ')' / '[' (del_target (',' del_target)* ','?)? ']'
assert <- 'assert' test (',' test)?
names <- name (',' name)*
import <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' (('.' / '...')* dotted / ('.' / '...')+) 'import' ('*' / '(' import_as (',' import_as)* ','? ')' / import_as (',' import_as)* !',')
import_as <- name ('as' name)?
dotted <- name ('.' name)*
type_alias <- TYPE name type_params? '=' test !'='
name <- NAME / MATCH / CASE / TYPE / UNDER
assignment <- annotated / augmented / plain
annotated <- ann_target ':' test ('=' (yield / star_list))?
ann_target <- single_target / '(' single_target ')'
augmented <- single_target AUG (yield / star_list)
plain <- (targets '=')* (yield / star_list) !('=' / AUG / ':')
targets <- star_target (',' star_target)* ','?
star_target <- '*' !'*' target / target
target <- single_target / '(' targets? ')' !trailer_start / '[' targets? ']' !trailer_start
single_target <- atom (trailer &trailer_start)* ('.' name / '[' slices ']') !trailer_start / name !trailer_start / '(' single_target ')' !trailer_start
trailer_start <- '.' / '[' / '('
yield <- 'yield' ('from' test / star_list?)
star_list <- star_item (',' star_item)* ','?
star_item <- '*' bitor / named
named <- name ':=' test / test !':='
alone <- (NAME / NUMBER / 'None' / 'True' / 'False') &(',' / ')' / ']' / '}' / ':' / NEWLINE)
test <- alone / lambda / or_test ('if' or_test 'else' test)?
lambda <- 'lambda' lambda_params? ':' test
or_test <- not_test (('and' / 'or') not_test)*
not_test <- 'not' not_test / comparison
comparison <- bitor (comp_op bitor)*
comp_op <- COMPARE / 'in' / 'not' 'in' / 'is' 'not' / 'is'
bitor <- alone / unary ((ARITH / '*' / SIGN / '@' / '|' / SLASH) unary)*
unary <- (SIGN / '~') unary / power
power <- 'await'? primary ('**' unary)?
primary <- atom trailer*
trailer <- '.' name / '[' slices ']' / '(' args? ')'
slices <- slice (',' slice)* ','?
slice <- '*' bitor / test? ':' test? (':' test?)? / named
atom <- name / NUMBER / strings / 'None' / 'True' / 'False' / '...' / '(' (yield / genexp / star_list)? ')' / '[' (comp_item comp_for / star_list)? ']' / '{' (dict_or_set)? '}'
strings <- STRING+ / BYTES+
genexp <- named comp_for
comp_item <- named
dict_or_set <- test ':' test comp_for / named comp_for / dict_item (',' dict_item)* ','? / star_item (',' star_item)* ','?
dict_item <- '**' bitor / test ':' test
comp_for <- ('async'? 'for' targets_in 'in' or_test ('if' or_test_named)*)+
or_test_named <- name ':=' test / or_test !':=' / lambda
targets_in <- star_target_in (',' star_target_in)* ','?
star_target_in <- '*' target_in / target_in
target_in <- single_target / '(' targets ')' / '[' targets? ']' / '(' ')'
args <- genexp !',' / pos_arg (',' pos_arg)* (',' kw_arg (',' kw_or_star)*)? ','? / kw_arg (',' kw_or_star)* ','?
pos_arg <- '*' test / !(name '=') !'**' named
kw_arg <- name '=' test / '**' test
kw_or_star <- name '=' test / '**' test / '*' test
lambda_params <- l_slash / l_plain
l_slash <- l_defs ',' SLASH (',' (l_more)?)?
l_plain <- l_more
l_more <- l_defs (',' l_star?)? / l_star
l_star <- '*' name (',' l_kw)* (',' '**' name)? ','? / '*' (',' l_kw)+ (',' '**' name)? ','? / '**' name ','?
l_kw <- name ('=' test)?
l_defs <- l_req (',' l_req)* (',' l_def)* / l_def (',' l_def)*
l_req <- name !'='
l_def <- name '=' test
params <- p_slash / p_more
p_slash <- p_defs ',' SLASH (',' p_more?)?
p_more <- p_defs (',' p_star?)? / p_star
p_star <- '*' name p_star_ann? (',' p_kw)* (',' '**' name p_ann?)? ','? / '*' (',' p_kw)+ (',' '**' name p_ann?)? ','? / '**' name p_ann? ','?
p_star_ann <- ':' ('*' bitor / test)
p_kw <- name p_ann? ('=' test)?
p_defs <- p_req (',' p_req)* (',' p_def)* / p_def (',' p_def)*
p_req <- name p_ann? !'='
p_def <- name p_ann? '=' test
p_ann <- ':' test
compound <- if / while / for / try / with / def / class / decorated / async / match
block <- NEWLINE INDENT (NEWLINE / statement)+ DEDENT / simple
if <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while <- 'while' named ':' block ('else' ':' block)?
for <- 'for' targets_in 'in' star_list ':' block ('else' ':' block)?
try <- 'try' ':' block (except_star+ ('else' ':' block)? ('finally' ':' block)? / except_some+ except_any? ('else' ':' block)? ('finally' ':' block)? / except_any ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
except_some <- 'except' test ('as' name)? ':' block
except_any <- 'except' ':' block
except_star <- 'except' '*' test ('as' name)? ':' block
with <- 'with' (with_parens / with_item (',' with_item)* ':' block)
with_parens <- '(' with_item (',' with_item)* ','? ')' ':' block
with_item <- test 'as' with_target / test
with_target <- star_target &(',' / ')' / ':')
def <- 'def' name type_params? '(' params? ')' ('->' test)? ':' block
type_params <- '[' type_param (',' type_param)* ','? ']'
type_param <- ('*' / '**')? name (':' test)? ('=' ('*' bitor / test))?
class <- 'class' name type_params? ('(' args? ')')? ':' block
decorated <- ('@' named NEWLINE)+ (def / class / 'async' def)
async <- 'async' (def / for / with)
match <- MATCH subject ':' NEWLINE INDENT case+ DEDENT
subject <- star_item (',' star_item)* ','?
case <- CASE patterns ('if' named)? ':' block
patterns <- star_pattern (',' star_pattern)* ','?
star_pattern <- '*' name / as_pattern
as_pattern <- or_pattern ('as' !UNDER name)?
or_pattern <- closed ('|' closed)*
closed <- SIGN NUMBER (SIGN NUMBER)? / NUMBER (SIGN NUMBER)? / strings / 'None' / 'True' / 'False' / class_pattern / name ('.' name)* !('.' / '(' / '=') / '(' (star_pattern (',' star_pattern)* ','?)? ')' / '[' (star_pattern (',' star_pattern)* ','?)? ']' / '{' (map_pattern (',' map_pattern)* ','?)? '}'
class_pattern <- name ('.' name)* '(' (class_arg (',' class_arg)* ','?)? ')'
class_arg <- name '=' as_pattern / as_pattern
map_pattern <- '**' name / (SIGN? NUMBER (SIGN NUMBER)? / strings / 'None' / 'True' / 'False' / name ('.' name)+) ':' as_pattern
expression <- NEWLINE* star_list NEWLINE*
fstring_part <- NEWLINE* (yield / star_list) '='? NEWLINE*
"""

_AUG = {"+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "@=", "**=", "//=", "<<=", ">>="}
_COMPARE = {"<", ">", "<=", ">=", "==", "!="}
_ARITH = {"//", "%", "&", "^", "<<", ">>", "/", "|"}
_CLASS = {o: "AUG" for o in _AUG} | {o: "COMPARE" for o in _COMPARE} | {"+": "SIGN", "-": "SIGN"}
_CLASS |= {o: "ARITH" for o in _ARITH - {"|", "/"}} | {"/": "SLASH"}
_NUMBER = re.compile(r"0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?")
_OP = r"\*\*=?|//=?|>>=?|<<=?|\.\.\.|->|:=|[-+*/%&|^@=!<>]=?|[()\[\]{},:.;~]"
_REST = r"""(?P<nl>\r\n|\r|\n)|(?P<comment>\#[^\r\n]*)|(?P<cont>\\(?:\r\n|\r|\n))|(?P<string>[A-Za-z]{0,2}(?:\"\"\"|\'\'\'|\"|\'))|(?P<number>\d|\.\d)"""
_LEX = re.compile(rf"(?P<space>[ \t\f]+)|{_REST}|(?P<name>[^\W\d]\w*)|(?P<op>{_OP})")
# The same tokens with the space before them; the common ones first.
_TOKEN = re.compile(rf"""[ \t\f]*(?:(?P<name>[^\W\d]\w*+(?!["']))|(?P<op>(?!\.\d)(?:{_OP}))|{_REST}|(?P<joined>[^\W\d]\w*)|(?P<end>\Z))""")
_WORDS = {w: w for w in KEYWORDS} | {"match": "MATCH", "case": "CASE", "type": "TYPE", "_": "UNDER"}
_INDENT = re.compile(r"[ \t\f]*")
_PREFIXES = {"", "r", "u", "b", "f", "br", "rb", "fr", "rf"}
_ENDS = {q: re.compile(r"(?:\\.|\\\r\n|[^\\\n\r" + q + r"])*" + q, re.S) if len(q) == 1 else re.compile(r"(?:\\.|[^\\])*?" + q, re.S) for q in ('"', "'", '"""', "'''")}
_FRAGILE = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?![0-9a-fA-F]{8})|N(?!\{[^}]+\}))")


def _fstring(text: str, at: int, quote: str, raw: bool) -> tuple[int, list[tuple[int, int]]]:
    """End of an f-string's body and where the sources of its replacement fields lie."""
    fields, i = [], at
    while i < len(text):
        c = text[i]
        if text.startswith(quote, i):
            return i + len(quote), fields
        if c == "\\" and not (raw and text[i + 1 : i + 2] in "{}"):
            i += 2 if text[i + 1 : i + 2] not in "{}" else 1
            if text.startswith("N{", i - 1) and not raw:
                i = text.find("}", i) + 1 or len(text)
        elif c in "\r\n" and len(quote) == 1:
            raise LexError(i)
        elif text.startswith("{{", i) or text.startswith("}}", i):
            i += 2
        elif c == "{":
            i, inner = _field(text, i + 1, quote)
            fields += inner
        elif c == "}":
            raise LexError(i)
        else:
            i += 1
    raise LexError(len(text))


def _field(text: str, at: int, quote: str) -> tuple[int, list[tuple[int, int]]]:
    depth, i, inner = 0, at, []
    while i < len(text):
        c = text[i]
        m = _LEX.match(text, i)
        if m and m.lastgroup == "string" and m[0].lower().rstrip("\"'") in _PREFIXES:
            q = m[0][len(m[0].rstrip("\"'")) :]
            prefix = m[0][: len(m[0]) - len(q)].lower()
            if "f" in prefix:
                i, more = _fstring(text, m.end(), q, "r" in prefix)
                inner += more
                continue
            e = _ENDS[q].match(text, m.end())
            if not e:
                raise LexError(i)
            i = e.end()
            continue
        if c in "([{":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "}" and depth > 0:
            depth -= 1
        elif depth == 0 and (c == "}" or c == ":" or c == "!" and text[i + 1 : i + 2] != "="):
            if not text[at:i].strip():
                raise LexError(i)
            inner = [(at, i), *inner]
            if c == "!":
                m = re.compile(r"!\s*[sra]\s*(?=[:}])").match(text, i)
                if not m:
                    raise LexError(i)
                i = m.end()
                c = text[i]
            if c == ":":
                i += 1
                while i < len(text) and text[i] != "}":
                    if text[i] == "{":
                        i, more = _field(text, i + 1, quote)
                        inner += more
                    elif text.startswith(quote, i) or len(quote) == 1 and text[i] in "\r\n":
                        raise LexError(i)
                    else:
                        i += 1
            if i >= len(text):
                raise LexError(len(text))
            return i + 1, inner
        elif c == "#":
            if len(quote) == 1:
                raise LexError(i)
            while i < len(text) and text[i] not in "\r\n":
                i += 1
            continue
        i += 1
    raise LexError(len(text))


def lex(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Token symbols, their offsets, and the spans of the sources of f-string fields."""
    symbols, offsets, fields = [], [], []
    indents, depth, i, n = [(0, 0)], [], 0, len(text)
    if text.startswith("\ufeff"):
        i = 1
    if "\0" in text:
        raise LexError(text.index("\0"))
    fresh = True
    while i < n:
        if fresh and not depth:
            start, blank = i, _INDENT.match(text, i)[0]
            i += len(blank)
            col = alt = len(blank)
            if blank.strip(" "):
                col = alt = 0
                for c in blank:
                    if c == "\f":
                        col = alt = 0
                    else:
                        col, alt = col + 1 if c == " " else (col // 8 + 1) * 8, alt + 1
            if i < n and text[i] in "#\r\n" or i >= n:
                fresh = False
                if i >= n:
                    break
                m = _LEX.match(text, i)
                i = m.end()
                if m.lastgroup == "comment":
                    m = re.compile(r"\r\n|\r|\n").match(text, i)
                    i = m.end() if m else n
                fresh = True
                continue
            if text[i] == "\\" and (m := _LEX.match(text, i)) and m.lastgroup == "cont":
                i = m.end()
                continue
            fresh = False
            if (col, alt) != indents[-1]:
                if col > indents[-1][0] and alt > indents[-1][1]:
                    indents.append((col, alt))
                    symbols.append("INDENT")
                    offsets.append(start)
                elif col < indents[-1][0]:
                    while col < indents[-1][0]:
                        indents.pop()
                        symbols.append("DEDENT")
                        offsets.append(start)
                    if (col, alt) != indents[-1]:
                        raise LexError(i)
                else:
                    raise LexError(i)
        m = _TOKEN.match(text, i)
        if m is None:
            raise LexError(_INDENT.match(text, i).end())
        kind = m.lastgroup
        at, i = m.span(kind)
        if kind == "name" or kind == "joined":
            word = text[at:i]
            if not word.isascii() and not unicodedata.normalize("NFKC", word).isidentifier():
                raise LexError(at)
            symbols.append(_WORDS.get(word, "NAME"))
            offsets.append(at)
            continue
        if kind == "op":
            op = text[at:i]
            if op in "([{":
                depth.append(op)
            elif op in ")]}":
                if not depth or "([{".index(depth.pop()) != ")]}".index(op):
                    raise LexError(at)
            elif op == "!":
                raise LexError(at)
            symbols.append(_CLASS.get(op, op))
            offsets.append(at)
            continue
        if kind == "comment" or kind == "end":
            continue
        if kind == "cont":
            if i >= n:
                raise LexError(at)
            continue
        if kind == "nl":
            if not depth:
                symbols.append("NEWLINE")
                offsets.append(at)
                fresh = True
            continue
        offsets.append(at)
        if kind == "string":
            opened = text[at:i]
            q = opened.lstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
            prefix = opened[: len(opened) - len(q)].lower()
            if prefix not in _PREFIXES:
                raise LexError(at)
            if "f" in prefix:
                i, more = _fstring(text, i, q, "r" in prefix)
                fields += more
            else:
                e = _ENDS[q].match(text, i)
                if e is None:
                    raise LexError(n if len(q) == 3 else at)
                if "b" in prefix and not e[0].isascii() or "r" not in prefix and "b" not in prefix and "\\" in e[0] and _FRAGILE.search(e[0].replace("\\\\", "")):
                    raise LexError(at)
                if prefix == "b" and re.search(r"\\x(?![0-9a-fA-F]{2})", e[0].replace("\\\\", "")):
                    raise LexError(at)
                i = e.end()
            symbols.append("BYTES" if "b" in prefix else "STRING")
        else:
            m = _NUMBER.match(text, at)
            i = m.end()
            if re.fullmatch(r"0[\d_]*[1-9][\d_]*", m[0]):
                raise LexError(at)
            if i < n and (text[i].isalnum() or text[i] == "_") and not re.compile(r"(?:and|else|for|if|in|is|not|or)\b").match(text, i):
                raise LexError(i)
            symbols.append("NUMBER")
    if symbols and symbols[-1] != "NEWLINE":
        symbols.append("NEWLINE")
        offsets.append(n)
    for _ in indents[1:]:
        symbols.append("DEDENT")
        offsets.append(n)
    return symbols, offsets, fields
