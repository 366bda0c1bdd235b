"""Column builders for nucleotide and amino-acid sequences.

All are built-in expressions: nothing here leaves the JVM. A null sequence gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbol orders of the two alphabets, and the codon table in TCAG order.
NUCLEOTIDES = "TCAG"
AMINO_ACIDS = "FLSYCWPHQRIMTNKVADEG"
CODON_TABLE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
AMBIGUOUS = {"Y": "TC", "R": "AG", "W": "TA", "S": "CG", "K": "TG", "M": "CA", "V": "CAG", "D": "TAG", "H": "TCA", "B": "TCG", "N": "TCAG"}

CODONS = {a + b + c: CODON_TABLE[16 * i + 4 * j + k] for i, a in enumerate(NUCLEOTIDES) for j, b in enumerate(NUCLEOTIDES) for k, c in enumerate(NUCLEOTIDES)}


def overlapping(seq: Column, letters: int) -> Column:
    """All substrings of so many letters, in order; one pass over the sequence, whatever its length."""
    return F.regexp_extract_all(seq, F.lit(rf"(?s)(?=(.{{{letters}}}))"), F.lit(1))


def in_turn(seq: Column, letters: int) -> Column:
    """Substrings of so many letters side by side; what is left over at the end is dropped."""
    return F.regexp_extract_all(seq, F.lit(rf"(?s).{{{letters}}}"), F.lit(0))


def scrub(text: Column) -> Column:
    """Without NUL, space, carriage return, tab and line feed."""
    return F.regexp_replace(text, r"[\x00\x20\r\t\n]", "")


def nucleotide_code(base: Column) -> Column:
    """0 to 3 in the order TCAG (U is T), by letter in either case; null for anything else."""
    return F.nullif(F.instr(F.lit(NUCLEOTIDES), F.translate(F.upper(base), "U", "T")) - 1, F.lit(-1))


def resolved(seq: Column, key: Column) -> Column:
    """Ambiguity letters replaced by one base of their set, chosen by a hash of ``key`` and the place."""

    def one(c: Column, i: Column) -> Column:
        out = c
        for letter, bases in AMBIGUOUS.items():
            pick = F.substr(F.lit(bases), F.pmod(F.xxhash64(key, i), F.lit(len(bases))).cast("int") + 1, F.lit(1))
            out = F.when(c == letter, pick).otherwise(out)
        return out

    letters = F.transform(F.split(F.upper(seq), ""), one)
    return F.when(F.length(seq) == 0, "").otherwise(F.array_join(letters, ""))


def with_noise(seq: Column, rate: float, seed: int, key: Column) -> Column:
    """Each base replaced by a random one at ``rate``; draws depend on seed, key and place only."""
    draw = lambda i, salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key, i), F.lit(1 << 20))

    def one(c: Column, i: Column) -> Column:
        other = F.substr(F.lit(NUCLEOTIDES), F.pmod(draw(i, 1), F.lit(4)).cast("int") + 1, F.lit(1))
        return F.when(draw(i, 0) < int(rate * (1 << 20)), other).otherwise(c)

    return F.when(F.length(seq) == 0, "").otherwise(F.array_join(F.transform(F.split(seq, ""), one), ""))


def amino_code(letter: Column) -> Column:
    """Place among the 20 amino acids from 0; -1 for anything else."""
    return F.when(F.length(letter) == 1, F.instr(F.lit(AMINO_ACIDS), letter) - 1).otherwise(-1)


def word_code(word: Column, symbols: str = NUCLEOTIDES) -> Column:
    """A word as a number in the base of its alphabet, first symbol highest; null if a symbol is not of it."""
    digits = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(symbols), c) - 1)
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda acc, d: acc * len(symbols) + d)
    return F.when((F.length(word) > 0) & ~F.exists(digits, lambda d: d < 0), total)


def word_of_code(code: Column, length: int, symbols: str = NUCLEOTIDES) -> Column:
    """The word of ``length`` symbols that has this number; null if it is out of range."""
    base = len(symbols)
    letters = [F.substr(F.lit(symbols), F.pmod(F.floor(code / base**i), F.lit(base)).cast("int") + 1, F.lit(1)) for i in reversed(range(length))]
    return F.when((code >= 0) & (code < base**length), F.concat(*letters))


def reverse_complement(seq: Column) -> Column:
    """Of the letters ACGTUWSYRN; every other letter becomes N."""
    known = F.regexp_replace(F.upper(seq), "[^ACGTUWSYRN]", "N")
    return F.reverse(F.translate(known, "ACGTUWSYRN", "TGCAAWSRYN"))


def reverse_complement_indel(seq: Column) -> Column:
    """As ``reverse_complement`` for reads with corrected indels: lower-case letters (insertions), ``n`` and ``x`` keep their case; others become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGTacgtnx]", "N"), "ACGTacgtnx", "TGCAtgcanx"))


def base_number(base: Column, opposite: bool = False) -> Column:
    """0 to 3 in the order ACGT in either case, or of the opposite base; 4 for anything else."""
    at = F.instr(F.lit("TGCA" if opposite else "ACGT"), F.upper(base)) - 1
    return F.when((F.length(base) == 1) & (at >= 0), at).otherwise(4)


def indel_number(base: Column) -> Column:
    """The opposite base's number: 0 to 3 for upper case, 5 to 8 for lower, 9 for n, 10 for x, 4 for anything else."""
    at = F.instr(F.lit("TGCA"), base) - 1
    low = F.instr(F.lit("tgcanx"), base) + 4
    return F.when(F.length(base) != 1, 4).when(at >= 0, at).when(low > 4, low).otherwise(4)


def codon(triple: Column) -> Column:
    """The amino acid of three bases, ``*`` for a stop; null if a letter is not a base."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    return F.element_at(table, F.translate(F.upper(triple), "U", "T"))


def translated(seq: Column, stop: bool = True, unknown: str = "X") -> Column:
    """The first reading frame in amino acids, up to its first stop codon; a partial codon is dropped."""
    protein = F.array_join(F.transform(in_turn(seq, 3), lambda c: F.coalesce(codon(c), F.lit(unknown))), "")
    return F.split_part(protein, F.lit("*"), F.lit(1)) if stop else protein


def antisense(seq: Column, unknown: str = "X") -> Column:
    """The protein of the opposite strand, codon by codon, stops kept as ``*``."""
    return translated(reverse_complement(seq), stop=False, unknown=unknown)


def trinucleotide(seq: Column, at: Column) -> Column:
    """Number 0 to 63 of three bases in the order ACGT; a letter that is no base makes it 0."""
    code = word_code(F.translate(F.upper(F.substr(seq, at, F.lit(3))), "U", "T"), "ACGT")
    return F.coalesce(F.when(F.length(seq) >= at + 2, code), F.lit(0)).cast("int")


def gc_bucket(seq: Column) -> Column:
    """Percentage of G and C less 26, from 0 to 43; null for an empty sequence."""
    gc = F.length(F.regexp_replace(F.upper(seq), "[^GC]", ""))
    share = F.floor(100 * gc / F.nullif(F.length(seq), F.lit(0))).cast("int") - 26
    return F.when(share.isNotNull(), F.least(F.greatest(share, F.lit(0)), F.lit(43)))


def class_key(path: Column) -> Column:
    """File name up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def truth_key(label: Column) -> Column:
    """Label up to the first bar, colon or dot."""
    return F.regexp_extract(label, r"^([^|:.]*)", 1)


def short_label(label: Column) -> Column:
    """Label up to its first space."""
    return F.split_part(label, F.lit(" "), F.lit(1))


def gi_number(label: Column) -> Column:
    """Text between the first and the second bar; null if there are fewer than two."""
    parts = F.split(label, r"\|", -1)
    return F.when(F.size(parts) > 2, parts[1])
