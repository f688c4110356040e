from . import queries, stored, commands  # noqa: F401 - all fill the catalogue
