"""Block-sparse matrices and tensors as tables.

A tensor is a table of *cells*: one column for each leg's index and a value ``v``; an absent
cell is zero. A *catalog* ``(leg, idx, q)`` gives each index of a leg a charge; a *sector* is
what a key rule makes of the charges of some legs. A diagonal is a table of *weights*
``(sector, pos, dim, v)``, each value standing for ``dim`` equal ones. A *histogram*
``(key, n)`` counts the indices of a leg by charge.

All operators take and return DataFrames and are lazy, but for those that say so.
"""
