"""DataFrame-to-DataFrame operators."""

from tributary.operators.annotate import Annotator, AnnotatorMode, load_comments, update_comment
from tributary.operators.base import Transformer
from tributary.operators.cleaning import Cleaner, EnumCleaner, NullCleaner, ThresholdCleaner
from tributary.operators.explode import Exploder
from tributary.operators.filters import NoIdDropper, Sieve
from tributary.operators.latest import NewestByGroup
from tributary.operators.project import Mapper, MapperMode, MissingColumnHandling

__all__ = [
    "Annotator", "AnnotatorMode", "Cleaner", "EnumCleaner", "Exploder", "Mapper", "MapperMode", "MissingColumnHandling", "NewestByGroup",
    "NoIdDropper", "NullCleaner", "Sieve", "ThresholdCleaner", "Transformer", "load_comments", "update_comment",
]
