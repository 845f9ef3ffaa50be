"""Column functions on token arrays; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import sequences as S

# Ids of the special tokens; codons follow in the order of BASES.
CLS, SEP, UNK, PAD, MASK = range(5)
BASES = "ACGT"
IGNORED = -100


def codon_ids(seq: Column) -> Column:
    """The id of each codon; anything that is no codon is unknown."""

    def one(codon: Column) -> Column:
        a, b, c = (F.instr(F.lit(BASES), F.substring(codon, k, 1)) - 1 for k in (1, 2, 3))
        return F.when((a < 0) | (b < 0) | (c < 0), UNK).otherwise(MASK + 1 + 16 * a + 4 * b + c)

    return F.transform(S.codons(seq), one)


def byte_ids(text: Column, end: int | None = 0) -> Column:
    """The code of each character, with an end token if one is given."""
    ids = F.when(F.length(text) > 0, F.transform(F.split(text, ""), F.ascii)).otherwise(F.array().cast("array<int>"))
    return ids if end is None else F.concat(ids, F.array(F.lit(end)))


def framed(ids: Column, context: int) -> Column:
    """CLS, at most ``context - 2`` tokens, SEP, padding up to ``context``."""
    body = F.slice(ids, 1, context - 2)
    return F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)), F.array_repeat(F.lit(PAD), F.lit(context - 2) - F.size(body)))


def next_labels(ids: Column, pad: int) -> Column:
    """Each token's successor; the last has ``pad``."""
    return F.when(F.size(ids) > 0, F.concat(F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0))), F.array(F.lit(pad)))).otherwise(ids)


def genomic_labels(ids: Column) -> Column:
    """Labels of the codes of ACGT and acgt stay, all others are ignored."""
    return F.transform(ids, lambda x: F.when(x.isin([ord(c) for c in "ACGTacgt"]), x).otherwise(IGNORED))


def masked(ids: Column, key: Column, seed: int, share: float = 0.15) -> Column:
    """Structs ``input, label`` for masked-token training: a token is drawn by a hash of (seed, key, place); of the drawn
    80% become MASK, 10% another codon, 10% stay. Special tokens are never drawn. Twenty hash bits choose, twelve replace."""

    def one(x: Column, i: Column) -> Column:
        h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))), 1, 13), 16, 10).cast("long")
        roll, other = F.shiftright(h, 12) % 2**20, (h % 64).cast("int") + MASK + 1
        drawn = (x > MASK) & (roll < int(share * 2**20))
        new = F.when(roll < int(share * 0.8 * 2**20), MASK).when(roll < int(share * 0.9 * 2**20), other).otherwise(x)
        return F.struct(F.when(drawn, new).otherwise(x).alias("input"), F.when(drawn, x).otherwise(IGNORED).alias("label"))

    return F.transform(ids, one)


def lineage_tag(levels: dict[str, Column], key: Column, seed: int, dropout: float = 0.0) -> Column:
    """``|d__x;s__y|``; a level that a hash of (seed, key, level) drops, or that is null, reads ``None``."""

    def shown(name: str, value: Column) -> Column:
        roll = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(name))), 1, 8), 16, 10).cast("double") / 2.0**32
        return F.concat(F.lit(f"{name}__"), F.coalesce(F.when(roll >= dropout, value), F.lit("None")))

    return F.concat(F.lit("|"), F.concat_ws(";", *(shown(k, v) for k, v in levels.items())), F.lit("|"))


def inject_tag(seq: Column, tag: Column, spacing: int) -> Column:
    """The tag before each piece of ``spacing`` less its own length."""
    piece = F.concat(F.lit("(?s).{1,"), (F.lit(spacing) - F.length(tag)).cast("string"), F.lit("}"))
    pieces = F.regexp_extract_all(seq, piece, F.lit(0))
    return F.when(F.length(seq) > 0, F.concat(tag, F.call_function("array_join", pieces, tag))).otherwise("")


def joined(ids: Column) -> Column:
    """An array as text, for digests and comparisons."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# What counts as sequence in a tagged text (bases and degenerate bases in both cases, the gap, the split marks).
SEQUENCE_CLASS = r"[-@#ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn]"
END = "\u0100"  # stands for an end token in texts; no byte has it


def tag_mask(ids: Column, longest: int = 2048, end: int = 0) -> Column:
    """1 on sequence, 0 on lineage tags, for codes of characters. Documents lie between end tokens, which stay on. In a document
    the pieces between pipes are tags and sequence in turn; whether the first is a tag shows in what follows its pipe.
    A piece of ``longest`` or more is no tag whatever its turn, and the next then is one. A document without a pipe goes
    as a whole if it is shorter than that and has anything but sequence in it. Pipes, and what is no sequence, are off.
    A lone token is off only if it is one of ``|_;`` and space."""
    text = F.array_join(F.transform(ids, lambda x: F.when(x == end, F.lit(END)).when(x.between(1, 255), F.char(x.cast("long"))).otherwise("?")), "")
    plain = lambda s: ~s.rlike(f"[^{SEQUENCE_CLASS[1:]}")
    bits = lambda s, on: F.repeat(F.when(on, "1").otherwise("0"), F.length(s))

    def document(s: Column) -> Column:
        pieces = F.split(s, r"\|", -1)
        head = F.get(pieces, F.lit(0))
        rest = F.substring(s, F.length(head) + 2, F.length(s))
        short = F.length(head) < longest
        first_is_tag = (
            F.when(F.length(rest) == 0, ~plain(head))
            .when(F.length(rest) == 1, ~rest.rlike("^[DdRr;]"))
            .otherwise(~rest.rlike("(?s)^(?:;|._)"))
        )
        start = F.struct(first_is_tag.alias("tag"), F.lit("").alias("out"))

        def turn(state: Column, piece: Column) -> Column:
            off = state["tag"] & (F.length(piece) < longest)
            return F.struct((~off).alias("tag"), F.concat(state["out"], bits(piece, ~off), F.lit("0")).alias("out"))

        walked = F.aggregate(pieces, start, turn)["out"]
        closed = F.when(F.length(rest) == 0, F.concat(bits(head, ~(short & ~plain(head))), F.lit("0"))).otherwise(F.substring(walked, F.lit(1), F.length(s)))
        return F.when(F.size(pieces) > 1, closed).otherwise(bits(s, ~(short & ~plain(s))))

    mask = F.array_join(F.transform(F.split(text, END, -1), document), "1")
    # Mask and text are zipped: inside a lambda they would be computed again for every token.
    on = lambda m, c: F.when((c == END) | ((m == "1") & c.rlike(f"^{SEQUENCE_CLASS}$")), 1).otherwise(0)
    sequence = F.zip_with(F.split(mask, ""), F.split(text, ""), on)
    lone = F.array(F.when(F.char(F.get(ids, F.lit(0)).cast("long")).isin("|", "_", ";", " "), 0).otherwise(1))
    return F.when(F.size(ids) == 0, F.array().cast("array<int>")).when(F.size(ids) == 1, lone).otherwise(sequence)


def variant_input(ids: Column, place: Column, new: Column) -> Column:
    """A framed row with the token of codon ``place`` (after CLS) replaced; a place beyond the tokens fails the job."""
    inside = (place >= 0) & (place < F.size(ids) - 2)
    at = place.cast("int") + 2
    row = F.concat(F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(new), F.slice(ids, F.greatest(at + 1, F.lit(1)), F.size(ids)))
    return F.when(inside, row).otherwise(F.raise_error(F.lit("the variant lies outside its row")).cast("array<int>"))


def control_name(name: Column) -> Column:
    """``<ctrl_a>`` of an id ``A__rest``."""
    return F.concat(F.lit("<ctrl_"), F.lower(F.split_part(name, F.lit("__"), F.lit(1))), F.lit(">"))


def headed(ids: Column, head: list[int], tail: list[int], pad: int, context: int) -> Column:
    """Head, tokens as room is left, tail, padding up to ``context``."""
    room = context - len(head) - len(tail)
    if room < 0:
        raise ValueError("no room for tokens")
    fixed = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    body = F.slice(ids, 1, room)
    return F.concat(fixed(head), body, fixed(tail), F.array_repeat(F.lit(pad), F.lit(room) - F.size(body)))


def class_labels(labels: Column, classes: str, start: Column, stop: Column) -> Column:
    """The class of each letter of ``labels`` in [start, stop), between two ignored places for special tokens; unknown letters are ignored."""
    one = lambda x: F.when(F.instr(F.lit(classes), x) > 0, F.instr(F.lit(classes), x) - 1).otherwise(IGNORED)
    part = F.substring(labels, start + 1, stop - start)
    edge = F.array(F.lit(IGNORED))
    return F.concat(edge, F.when(F.length(part) > 0, F.transform(F.split(part, ""), one)).otherwise(F.array().cast("array<int>")), edge)


def token_types(ids: Column) -> Column:
    """0 for special tokens, else 1 and the place of the codon's residue in RESIDUES."""

    def one(x: Column) -> Column:
        codon = F.concat(*(F.substring(F.lit(BASES), F.floor((x - MASK - 1) / k).cast("int") % 4 + 1, F.lit(1)) for k in (16, 4, 1)))
        return F.when(x <= MASK, 0).otherwise(F.instr(F.lit(S.RESIDUES), S.amino_acid(codon)))

    return F.transform(ids, one)


def upper_ids(ids: Column) -> Column:
    """Codes of a-z become those of A-Z."""
    return F.transform(ids, lambda x: F.when(x.between(97, 122), x - 32).otherwise(x))


# Classes of secondary structure, three or eight of them.
THREE_STATES = {"H": 0, "E": 1, "C": 2}
EIGHT_STATES = {"G": 0, "H": 1, "I": 2, "B": 3, "E": 4, "S": 5, "T": 6, "C": 7}


def structure_labels(states: Column, classes: dict[str, int]) -> Column:
    """A label for each state, between two ignored ones for the special tokens; other characters are ignored too."""
    codes = F.when(F.length(states) > 0, F.split(states, "")).otherwise(F.array().cast("array<string>"))
    table = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))
    end = F.array(F.lit(IGNORED))
    return F.concat(end, F.transform(codes, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(IGNORED))), end)


def framed_keeping_end(ids: Column, context: int) -> Column:
    """CLS, tokens and SEP cut to ``context`` in such a way that SEP stays last; no padding."""
    return F.concat(F.array(F.lit(CLS)), F.slice(ids, 1, context - 2), F.array(F.lit(SEP)))


def prediction_row(ids: Column, end: int | None) -> Column:
    """Struct ``ids, positions, mask``: an optional leading end token has mask 0."""
    head = F.array(F.lit(end)) if end is not None else F.array().cast("array<int>")
    row = F.concat(head, ids)
    n = F.size(row)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(row.alias("ids"), places.alias("positions"), F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(F.lit(1), F.size(ids))).alias("mask"))
