"""Small inputs shared by the tests."""

from portolan.schemas import RAW_ENTRIES

# Port labels that are read in a way of their own (see
# `portolan.operators.ports`), as they are printed.
SETTLED_LABELS = {
    "GTF": "Collapsed into INT, MN", "PDN": "PASO DEL NORTE,TX     ",
    "BLI": "BELLINGHAM, WASHINGTON #INTL", "888": "UNIDENTIFED AIR / SEAPORT",
    "UNK": "UNKNOWN POE           ",
}

# A label text with every printed shape; its other names are invented.
LABEL_TEXT = "\r\n".join([
    "libname library 'somewhere' ;",
    "proc format library=library ;",
    "",
    "/* I94CIT & I94RES - all the codes */",
    "  value cntyl",
    "   501 =  'NORDLAND Air Sea, and Not Counted (X-1, no land)'",
    "   502 =  'SUDLAND '",
    "   503 =  'INVALID: FAR ISLES (NORTH/SOUTH TERR.)' ",
    "    0  =  'INVALID: NOWHERE'",
    "   996 =  'No Land Code (996)' ;",
    "",
    "/* I94PORT - all the codes */",
    "  value $prtl",
    "   'AAA'\t=\t'ARDEN, AK             '",
    "   'BBB'\t=\t'BRISK, CA -ARPT       '",
    "   'CCC'\t=\t'LOW ROCK, AR (BPS)'",
    "   'DDD'\t=\t'MARLOW AZ             '",
    "   'EEE'\t=\t'MID''L FALLS, MN      '",
    "   'FFF'\t=\t'LA GRANJA, NY         '",
    "   'GGG'\t=\t'ELM/OAK, NC           '",
    "   'HHH'\t=\t'UP-IN-ARMS, OH        '",
    "   'III'\t=\t'TARN, ELSEWHERE       '",
    *[f"   '{code}'\t=\t'{label}'" for code, label in SETTLED_LABELS.items()],
    "   'AG'\t\t=\t'No PORT Code (AG)'",
    "   'CP '\t=\t'No PORT Code (CP)'",
    "   'NK' \t=\t'No PORT Code (NK)'",
    ";",
    "",
    "/* ARRDATE is the arrival date. */",
    "/* I94MODE - missing values as well as not reported (9) */",
    "value model",
    "\t1 = 'Wings'",
    "\t2 = 'Hull'",
    "\t3 = 'Wheels'",
    "\t9 = 'Not told' ;",
    "",
    "/* I94ADDR - everything else goes into 'other' */",
    "value addrl",
    *[f"\t'{code}'='STATE OF {code}'" for code in [
        "AK", "AR", "AZ", "CA", "IN", "LA", "MN", "NC", "NY", "OH", "TX", "WA"]],
    "\t'99'='Any Other Code' ;",
    "",
    "/* I94VISA - Visa codes collapsed into three categories:",
    "   1 = Trade",
    "   2 = Leisure trip",
    "   3 = Study",
    "*/",
    "/* BIRYEAR - 4 digit year of birth */",
    "run ;",
    "",
])

CITY_TEXT = "\n".join([
    "City;State;Median Age;Male Population;Female Population;Total Population;"
    "Number of Veterans;Foreign-born;Average Household Size;State Code;Race;Count",
    "Albany;New York;33.8;100;120;220;10;30;2.5;NY;White;1",
    "Albany;New York;33.8;100;120;220;10;30;2.5;NY;Asian;2",
    "Austin;Texas;30.1;400;oops;810.0;20;;2.75;TX;White;3",
    "",
])


def entries(spark, *rows):
    """Raw entry rows from dicts; columns left out are NULL."""
    names = RAW_ENTRIES.fieldNames()
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], RAW_ENTRIES)


def plan(df):
    return df._jdf.queryExecution().toString()
