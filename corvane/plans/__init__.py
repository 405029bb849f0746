"""Registered queries, by family."""


def load() -> None:
    """Imports every module of this package that registers queries."""
    from corvane.plans import agent, events, everyday, insight, knowledge, relational, retrieval, sequences, service, streams, texts  # noqa: F401
