from .checked import QualityError, load_period, replace_period, save_by_period, save_checked
from .schemas import INPUTS
from .tables import discard, load, materialise, save, shared_folder

__all__ = [
    "INPUTS", "QualityError", "discard", "load", "load_period", "materialise", "replace_period", "save", "save_by_period",
    "save_checked", "shared_folder",
]
