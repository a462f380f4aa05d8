from rawharbor.operators import align, compare, history, joins, profile, quality, ranking, resolve

__all__ = ["align", "compare", "history", "joins", "profile", "quality", "ranking", "resolve"]
