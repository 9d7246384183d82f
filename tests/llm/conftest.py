from tests.llm.fixtures import docs  # noqa: F401
