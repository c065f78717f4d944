"""Fixed inputs of queries that need none from the tables."""

QUERIES = [(1, "the worthless trash"), (2, "how to license the Apache software"), (3, "Erreth was of retihaou"), (4, "disgusting stupid password"), (5, "Geieen ererie der")]
PHRASES = [(1, "of.the"), (2, "de.la that.the"), (3, "der.die")]
OVERLAPS = [(1, "small red rings"), (2, "the bolts of old gears"), (3, "blue widgets"), (4, "hot")]
FIELD_QUERIES = [(1, "src1 license"), (2, "Erreth"), (3, "src10 fr the")]
DESCRIPTIONS = [(0, "a.b.Erreth"), (1, "a.Geieen"), (2, "Apache")]
CLASS_NAMES = [(1, "NATION_7"), (2, "AMERICA.NATION_1"), (3, "NATIOM_7"), (4, "world.ASIA"), (5, "ASIA")]
METHOD_QUERIES = [(1, "please callEurope and callAsia"), (2, "callNation7 or callNobody"), (3, "nothing")]
CUT = "1998-04-25"
USED = "stupid"
SEGMENT = "BUILDING"
META = [("api", "2024-05-01T00:00:00Z", "nomic-embed-text", None), ("guide", "2024-05-02T00:00:00Z", "nomic-embed-text", None), ("mod", None, None, 30), ("other", None, None, None)]
# Source files that are made of customers and their orders; names between < and > stand for columns.
CLASS_TEXT = """package shop;

/** A customer; not { open. */
public class <name> {
    private int[] sizes = {1, 2, 3};

    /** Makes one. */
    public <name>(int n) {
        this.n = n;
    }

<methods>}
"""
METHOD_TEXT = """    /** Order { <key>. */
    @Marks({"a;", "}"})
    public String <word>(int a, String b) {
        // } <priority>
        if (a > 0) { return "{ <key>"; }
        char c = '{'; /* } */
        int[] l = {1, 2};
        return b;
    }

    abstract void close<key>();

"""
