"""Column expressions over byte sequences, integers and bits.  All of them stay in the JVM unless they say otherwise."""
