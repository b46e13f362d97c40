from . import jsonvals, text

__all__ = ["jsonvals", "text"]
