from .columns import band, bin_index, day, hash32, known, mean, micros, number, ratio, text_key, tier, two_sided_p
from .tails import student_tail

__all__ = [
    "band", "bin_index", "day", "hash32", "known", "mean", "micros", "number", "ratio", "student_tail", "text_key",
    "tier", "two_sided_p",
]
