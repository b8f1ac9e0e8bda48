"""tracelake: session-trace analytics and retrieval as PySpark DataFrame operators."""
