"""Small helpers on results: budgets, pages, reports."""

from tidemark.functions.results import fitted, next_page, page_start, plot_html, report, spaced, tokens

__all__ = ["fitted", "next_page", "page_start", "plot_html", "report", "spaced", "tokens"]
