"""PostgreSQL's ``hashtext`` as Spark SQL: its hash of a text's bytes in 32-bit column arithmetic.

Bytes are taken twelve at a time as three little-endian words that are added to the state (a, b, c), which is
mixed; what is left is added with the length's byte kept free, and the state is made final. A step needs
what the step before gave more than once, so each is a lambda over the state.
"""

from __future__ import annotations

# fixed values: the start of the state, and how far each step of mixing and of the end rotates
START = 0x9E3779B9 + 3923095
MIX = (4, 6, 8, 16, 19, 4)
FINAL = (14, 11, 25, 16, 4, 14, 24)
_MASK = 0xFFFFFFFF


def _state(a: str, b: str, c: str) -> str:
    return f"named_struct('a', {a}, 'b', {b}, 'c', {c})"


def _then(state: str, a: str = "s.a", b: str = "s.b", c: str = "s.c") -> str:
    """The state made of the state s."""
    return f"transform(array({state}), s -> {_state(a, b, c)})[0]"


def _turned(x: str, by: int) -> str:
    return f"((shiftleft({x}, {by}) | shiftright({x}, {32 - by})) & {_MASK})"


def _mixed(state: str) -> str:
    for i, by in enumerate(MIX):
        x, y, z = (("a", "c", "b"), ("b", "a", "c"), ("c", "b", "a"))[i % 3]
        state = _then(state, **{x: f"(((s.{x} - s.{y}) & {_MASK}) ^ {_turned(f's.{y}', by)})", y: f"((s.{y} + s.{z}) & {_MASK})"})
    return state


def _ended(state: str) -> str:
    for i, by in enumerate(FINAL):
        x, y = (("c", "b"), ("a", "c"), ("b", "a"))[i % 3]
        state = _then(state, **{x: f"(((s.{x} ^ s.{y}) - {_turned(f's.{y}', by)}) & {_MASK})"})
    return state


def _word(at: str) -> str:
    """The little-endian word that begins at that byte of t.hex."""
    pairs = ", ".join(f"substr(t.hex, 2 * ({at}) + {2 * i + 1}, 2)" for i in (3, 2, 1, 0))
    return f"cast(conv(concat({pairs}), 16, 10) AS bigint)"


def hashtext_sql(text: str) -> str:
    """Spark SQL for ``hashtext(text)``; null gives null."""
    plus = lambda of, at, shift="": f"(({of} + {f'shiftleft({_word(at)}, {shift})' if shift else _word(at)}) & {_MASK})"
    begin = f"((cast({START} AS bigint) + t.n) & {_MASK})"
    block = _state(plus("m.a", "12 * i"), plus("m.b", "12 * i + 4"), plus("m.c", "12 * i + 8"))
    blocks = f"aggregate(if(t.n < 12, array(), sequence(0, t.n div 12 - 1)), {_state(begin, begin, begin)}, (m, i) -> {_mixed(block)})"
    rest = "12 * (t.n div 12)"
    ended = _ended(f"transform(array({blocks}), m -> {_state(plus('m.a', rest), plus('m.b', f'{rest} + 4'), plus('m.c', f'{rest} + 8', '8'))})[0]")
    signed = f"transform(array({ended}), s -> cast(if(s.c > 2147483647, s.c - 4294967296, s.c) AS int))[0]"
    bytes_ = f"cast({text} AS string)"
    whole = f"named_struct('n', cast(octet_length({bytes_}) AS bigint), 'hex', concat(hex({bytes_}), repeat('00', 12)))"
    return f"transform(array({whole}), t -> if(t.n IS NULL, null, {signed}))[0]"
