"""All SQL texts by query name."""

from oracle.base import with_ctes
from oracle.jobs import CTES, JOBS, LIMITED, RECURSIVE
from oracle.questions import DASHBOARD, METRICS, QUESTIONS

SQL = {name: with_ctes(text) for name, text in {**QUESTIONS, **METRICS, **DASHBOARD}.items()}
SQL.update({name: with_ctes(text, CTES) for name, text in JOBS.items()})
SQL.update({name: f"WITH RECURSIVE ordered_hits AS ({CTES['ordered_hits']}),{LIMITED.replace('RECURSIVE ', '')} {text}" for name, text in RECURSIVE.items()})
