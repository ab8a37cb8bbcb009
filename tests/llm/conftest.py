from tests.llm.fixtures import tables  # noqa: F401
