import pytest


@pytest.fixture(scope="session")
def labelled():
    """A folder with enough labels: the smallest has a handful of toxic documents, too few to learn a term from."""
    return "/root/testdata/sf0.01"
