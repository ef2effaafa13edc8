"""Lines of the two catalogs that several tests parse."""
HEADER_A = ["#Interaction ID", "Experimental System", "Experimental System Type", "Publication Source",
            "Organism ID Interactor A", "Organism ID Interactor B", "Throughput",
            "SWISS-PROT Accessions Interactor A", "TREMBL Accessions Interactor A",
            "SWISS-PROT Accessions Interactor B", "TREMBL Accessions Interactor B"]
ROWS_A = [
    "1\tTwo-hybrid\tphysical\tPUBMED:1111\t9606\t9606\tLow Throughput\tP46937\t-\tP60709\t-",
    "2\tDosage Rescue\tgenetic\tPUBMED:2222\t559292\t559292\tHigh Throughput\tP53894\t-\tP60010\t-",
    "3\tAffinity Capture-MS\tphysical\tPUBMED:3333\t9606\t9606\tHigh Throughput\tP99999\t-\tP88888\t-",
    "# comment", "", "short\trow",
]
ROWS_B = [
    "uniprotkb:P46937\tuniprotkb:P18206\tuniprotkb:P46937\tuniprotkb:P18206\tx\ty\tpsi-mi:\"MI:0018\"(two hybrid)\tSmith\t"
    "pubmed:4444\ttaxid:9606\ttaxid:9606\tpsi-mi:\"MI:0407\"(direct interaction)\tpsi-mi:intact\t-\t-",
    "uniprotkb:P53894\tuniprotkb:P60010\t-\t-\tx\ty\tpsi-mi:\"MI:0006\"(anti bait coip)\tLee\tpubmed:5555|imex:IM-15364-1\t"
    "taxid:559292\t-\tpsi-mi:\"MI:0915\"(physical association)\tpsi-mi:intact\t-\t-",
    "uniprotkb:P46937\tuniprotkb:P60709\t-\t-\tx\ty\tpsi-mi:\"MI:0018\"(two hybrid)\tLee\tpubmed:6666\t"
    "taxid:10090\ttaxid:9606\tpsi-mi:\"MI:0915\"(physical association)\tpsi-mi:intact\t-\t-",
]
