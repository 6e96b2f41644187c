"""Registered queries: a Spark callable each, and SQL that must give the same rows."""

from thermocline.session import tune

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(function):
        def run(spark, sf_dir):
            return function(tune(spark), sf_dir)

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = " ".join(sql.split("\n"))
        return function

    return register
