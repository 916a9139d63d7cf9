"""SQL texts that give the expected result of every registered query.

They state each query the plain way, with row-level joins over the pairs, and share no
code with the package.
"""
