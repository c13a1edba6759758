"""The standard genetic code, and how many sites of a codon are synonymous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Amino acids of the standard genetic code, codons in the order T, C, A, G of each letter.
LETTERS = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODE = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(LETTERS) for j, b in enumerate(LETTERS) for k, c in enumerate(LETTERS)}


def _sites(codon: str) -> tuple[float, float]:
    """Synonymous and non-synonymous sites: shares of the nine one-base neighbours, of three sites; a stop is non-synonymous."""
    same = sum(CODE[codon[:i] + b + codon[i + 1 :]] == CODE[codon] for i in range(3) for b in LETTERS if b != codon[i])
    return same / 3, (9 - same) / 3


#: Synonymous sites of each codon that isn't a stop; the rest of three is non-synonymous.
SYNONYMOUS = {c: _sites(c)[0] for c, a in CODE.items() if a != "*"}


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def translate(codon: Column) -> Column:
    """The amino acid of a codon; null for what isn't one."""
    return F.try_element_at(_map(CODE), codon)


def synonymous_sites(codon: Column) -> Column:
    """Null for stops and for codons with other letters."""
    return F.try_element_at(_map(SYNONYMOUS), codon)


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(F.translate(sequence, "ACGT", "TGCA"))


def codons(sequence: Column) -> Column:
    """Whole codons of a sequence; a partial one at the end is left out."""
    n = F.floor(F.length(sequence) / 3).cast("int")
    # sequence(1, 0) would count down
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(sequence, i * 3 - 2, F.lit(3)))).otherwise(F.array().cast("array<string>"))
