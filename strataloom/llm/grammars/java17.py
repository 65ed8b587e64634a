"""Java 17: tokens, and the grammar of a compilation unit over them."""

from __future__ import annotations

import re

from strataloom.llm.grammars import LexError

# The reserved words and literals.
KEYWORDS = set(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int
    interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _""".split()
)
_CONTEXTUAL = {"var": "VAR", "record": "RECORD", "sealed": "SEALED", "permits": "PERMITS", "yield": "YIELD", "module": "MODULE", "open": "OPEN"}
_PRIMITIVES = {"boolean", "byte", "char", "double", "float", "int", "long", "short"}

GRAMMAR = r"""
file <- modular / package? (import / ';')* type_decl*
modular <- import* annotation* OPEN? MODULE qname '{' directive* '}'
directive <- name (name / 'static' / '.' / ',')+ ';'
package <- annotation* 'package' qname ';'
import <- 'import' 'static'? name ('.' name)* ('.' '*')? ';'
qname <- name ('.' name)*
name <- NAME / VAR / RECORD / SEALED / PERMITS / YIELD / MODULE / OPEN
type_decl <- ';' / modifiers (class / record / enum / interface / annotation_decl)
modifiers <- modifier*
modifier <- annotation / MODIFIER / 'static' / 'final' / 'synchronized' / 'default' !(':' / '->') / SEALED &(modifier / 'class' / 'interface') / NAME_NON '-' SEALED
class <- 'class' name type_params? ('extends' type)? ('implements' types)? (PERMITS types)? class_body
record <- RECORD name type_params? '(' (component (',' component)*)? ')' ('implements' types)? class_body
component <- annotation* type (annotation* '...')? name
enum <- 'enum' name ('implements' types)? '{' (constant (',' constant)*)? ','? (';' member*)? '}'
constant <- annotation* name args? class_body?
interface <- 'interface' name type_params? ('extends' types)? (PERMITS types)? class_body
annotation_decl <- '@' 'interface' name '{' member* '}'
class_body <- '{' member* '}'
member <- ';' / 'static' block / block / modifiers (class / record / enum / interface / annotation_decl / type_params? method / constructor / field)
constructor <- type_params? name (params throws?)? block
method <- ('void' / type) name params dims? throws? (block / 'default' element_value ';' / ';')
throws <- 'throws' types
field <- type declarator (',' declarator)* ';'
declarator <- name dims? ('=' var_init)?
var_init <- array_init / expr
array_init <- '{' (var_init (',' var_init)*)? ','? '}'
params <- '(' (param (',' param)*)? ')'
param <- modifiers type (annotation* '...')? ((name '.')* 'this' / name dims?)
type_params <- '<' type_param (',' type_param)* '>'
type_param <- annotation* name ('extends' type ('&' type)*)?
types <- type (',' type)*
type <- annotation* (PRIMITIVE / class_type) dims?
dims <- (annotation* '[' ']')+
class_type <- name type_args? ('.' annotation* name type_args?)*
type_args <- '<' (type_arg (',' type_arg)*)? '>'
type_arg <- annotation* '?' (('extends' / 'super') type)? / type
annotation <- '@' !'interface' qname ('(' (pair (',' pair)* / element_value)? ')')?
pair <- name '=' element_value
element_value <- annotation / '{' (element_value (',' element_value)*)? ','? '}' / cond
block <- '{' block_statement* '}'
block_statement <- local_type / local_var ';' / statement
local_type <- modifiers (class / record / enum / interface)
local_var <- modifiers type declarator (',' declarator)*
statement <- block / ';' / 'if' par statement ('else' statement)? / 'while' par statement / 'do' statement 'while' par ';' / for / try / switch / 'synchronized' par block / 'return' expr? ';' / 'throw' expr ';' / ('break' / 'continue') name? ';' / 'assert' expr (':' expr)? ';' / YIELD !('=' / '.' / '(' ')' / '++' / '--' / '[') expr ';' / name ':' statement / statement_expr ';'
par <- '(' expr ')'
statement_expr <- ('++' / '--') unary / primary (('++' / '--') / assign expr) / call / new &(';' / ',' / ')')
call <- atom (suffix &suffix_start)* args !suffix_start / call_atom !suffix_start
call_atom <- ('this' / 'super') args
assign <- '=' / ASSIGN / '>' '>' '>=' / '>' '>='
for <- 'for' '(' (modifiers type name ':' expr / (local_var / statement_expr (',' statement_expr)*)? ';' expr? ';' (statement_expr (',' statement_expr)*)?) ')' statement
try <- 'try' ('(' resource (';' resource)* ';'? ')' block catch* finally? / block (catch+ finally? / finally))
resource <- modifiers type name '=' expr / primary
catch <- 'catch' '(' modifiers type ('|' type)* name ')' block
finally <- 'finally' block
switch <- 'switch' par '{' (label (':' (label ':')* block_statement* / '->' (block / 'throw' expr ';' / expr ';')))* '}'
label <- 'case' cond (',' cond)* / 'default'
expr <- lambda / cond (assign expr)?
lambda <- (name / '(' ')' / '(' name (',' name)* ')' / params) '->' (block / expr)
cond <- binary ('?' expr ':' (lambda / cond))?
binary <- unary (binop unary / 'instanceof' 'final'? annotation* type name?)*
binop <- BINARY / '<' / '>' '>' '>' !'=' / '>' '>' / '>' / '>=' / '&' / '|' / '+' / '-' / '*'
unary <- ('++' / '--' / '+' / '-' / '!' / '~') unary / cast / postfix
cast <- '(' PRIMITIVE dims? ')' unary / '(' type ('&' type)* ')' !('+' / '-' / '++' / '--') (lambda / unary)
postfix <- primary ('++' / '--')*
primary <- atom suffix*
suffix_start <- '.' / '(' / '[' / '::'
suffix <- '.' (type_args? name / new / 'this' / 'class' / 'super' ('::' name / args / &'.')) / args / '[' expr ']' / '::' type_args? (name / 'new')
atom <- LITERAL / 'this' / 'super' &('.' / '::' / '(') / new / switch / type_ref / '(' expr ')' / name
type_ref <- 'void' '.' 'class' / PRIMITIVE dims? ('.' 'class' / '::' 'new') / class_type dims ('.' 'class' / '::' 'new') / name type_args ('.' name type_args?)* '::' (name / 'new') / name ('.' name)* type_args '::' (name / 'new')
args <- '(' (expr (',' expr)*)? ')'
new <- 'new' type_args? annotation* (PRIMITIVE array / class_type (array / args class_body?))
array <- (annotation* '[' expr ']')+ dims? / dims array_init
"""

_OPS = sorted("( ) { } [ ] ; , ... . @ :: -> == != <= >= && || ++ -- += -= *= /= &= |= ^= %= << <<= = > < ! ~ ? : + - * / & | ^ %".split(), key=len, reverse=True)
_CLASS = {o: "ASSIGN" for o in ("+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=")} | {o: "BINARY" for o in ("==", "!=", "<=", "&&", "||", "<<", "/", "^", "%")}
_CLASS |= {w: "MODIFIER" for w in ("public", "protected", "private", "abstract", "native", "strictfp", "transient", "volatile")} | {w: "PRIMITIVE" for w in _PRIMITIVES} | {w: "LITERAL" for w in ("true", "false", "null")}
_LEX = re.compile(
    r'(?P<space>[ \t\f\r\n]+|//[^\r\n]*|/\*.*?\*/)'
    r'|(?P<block>"""[ \t\f]*\r?\n(?:\\.|[^\\])*?""")'
    r"""|(?P<string>"(?:\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2})|[^"\\\r\n])*")"""
    r"""|(?P<char>'(?:\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2})|[^'\\\r\n])')"""
    r"|(?P<number>0[xX][0-9a-fA-F](?:_*[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F_]*))?(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01](?:_*[01])*[lL]?|(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d(?:[\d_]*\d)?)?[lLfFdD]?)"
    r"|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>" + "|".join(map(re.escape, _OPS)) + ")",
    re.S,
)
_ESCAPE = re.compile(r"(?<!\\)((?:\\\\)*)\\u+([0-9a-fA-F]{4})")


def lex(text: str) -> tuple[list[str], list[int], list[str]]:
    symbols, offsets, i = [], [], 0
    if "\\u" in text:
        text = _ESCAPE.sub(lambda m: m[1] + chr(int(m[2], 16)), text)
    if text.startswith("﻿"):
        i = 1
    if text.endswith("\x1a"):
        text = text[:-1]
    while i < len(text):
        m = _LEX.match(text, i)
        if m is None:
            raise LexError(i)
        kind, word = m.lastgroup, m[0]
        if kind == "op" and word in ("/", "<") and text.startswith("/*", i):
            raise LexError(len(text))  # a comment without end
        if kind == "string" and word == '""' and text.startswith('"""', i):
            raise LexError(len(text))  # a text block without end
        if kind == "number" and m.end() < len(text) and (text[m.end()].isalnum() or text[m.end()] == "_"):
            raise LexError(m.end())
        if kind != "space":
            offsets.append(i)
            if kind == "name":
                if word in KEYWORDS:
                    symbols.append(_CLASS.get(word, word))
                elif word == "non" and text.startswith("non-sealed", i):
                    symbols.append("NAME_NON")
                else:
                    symbols.append(_CONTEXTUAL.get(word, "NAME"))
            elif kind == "op":
                symbols.append(_CLASS.get(word, word))
            else:
                symbols.append("LITERAL")
        i = m.end()
    return symbols, offsets, []
