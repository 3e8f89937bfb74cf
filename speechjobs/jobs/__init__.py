"""Jobs by flow; each module has QUERIES and, in SQL, ORACLE."""

from . import clean, files, repair, translate

JOBS = [clean, repair, translate, files]
