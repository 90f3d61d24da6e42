from .spec import IndexSpec

__all__ = ["IndexSpec"]
