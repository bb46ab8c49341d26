"""Bodies of licences, as lower-case terms: fixed values, read from their published texts."""

BODIES: dict[str, str] = {
    "Apache-2.0": (
        "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction "
        "and distribution 1 definitions license shall mean the terms and conditions for use reproduction and "
        "distribution as defined by sections 1 through 9 of this document licensor shall mean the copyright owner or "
        "entity authorized by the copyright owner that is granting the license legal entity shall mean the union of the "
        "acting entity and all other entities that control are controlled by or are under common control with that "
        "entity for the purposes of this definition control means i the power direct or indirect to cause the direction "
        "or management of such entity whether by contract or otherwise or ii ownership of fifty percent 50 or more of "
        "the outstanding shares or iii beneficial ownership of such entity you or your shall mean an individual or "
        "legal entity exercising permissions granted by this license source form shall mean the preferred form for "
        "making modifications including but not limited to software source code documentation source and configuration "
        "files object form shall mean any form resulting from mechanical transformation or translation of a source form "
        "including but not limited to compiled object code generated documentation and conversions to other media types "
        "work shall mean the work of authorship whether in source or object form made available under the license as "
        "indicated by a copyright notice that is included in or attached to the work an example is provided in the "
        "appendix below derivative works shall mean any work whether in source or object form that is based on or "
        "derived from the work and for which the editorial revisions annotations elaborations or other modifications "
        "represent as a whole an original work of authorship for the purposes of this license derivative works shall "
        "not include works that remain separable from or merely link or bind by name to the interfaces of the work and "
        "derivative works thereof contribution shall mean any work of authorship including the original version of the "
        "work and any modifications or additions to that work or derivative works thereof that is intentionally "
        "submitted to licensor for inclusion in the work by the copyright owner or by an individual or legal entity "
        "authorized to submit on behalf of the copyright owner for the purposes of this definition submitted means any "
        "form of electronic verbal or written communication sent to the licensor or its representatives including but "
        "not limited to communication on electronic mailing lists source code control systems and issue tracking "
        "systems that are managed by or on behalf of the licensor for the purpose of discussing and improving the work "
        "but excluding communication that is conspicuously marked or otherwise designated in writing by the copyright "
        "owner as not a contribution contributor shall mean licensor and any individual or legal entity on behalf of "
        "whom a contribution has been received by licensor and subsequently incorporated within the work 2 grant of "
        "copyright license subject to the terms and conditions of this license each contributor hereby grants to you a "
        "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare "
        "derivative works of publicly display publicly perform sublicense and distribute the work and such derivative "
        "works in source or object form 3 grant of patent license subject to the terms and conditions of this license "
        "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable "
        "except as stated in this section patent license to make have made use offer to sell sell import and otherwise "
        "transfer the work where such license applies only to those patent claims licensable by such contributor that "
        "are necessarily infringed by their contribution s alone or by combination of their contribution s with the "
        "work to which such contribution s was submitted if you institute patent litigation against any entity "
        "including a cross claim or counterclaim in a lawsuit alleging that the work or a contribution incorporated "
        "within the work constitutes direct or contributory patent infringement then any patent licenses granted to you "
        "under this license for that work shall terminate as of the date such litigation is filed 4 redistribution you "
        "may reproduce and distribute copies of the work or derivative works thereof in any medium with or without "
        "modifications and in source or object form provided that you meet the following conditions a you must give any "
        "other recipients of the work or derivative works a copy of this license and b you must cause any modified "
        "files to carry prominent notices stating that you changed the files and c you must retain in the source form "
        "of any derivative works that you distribute all copyright patent trademark and attribution notices from the "
        "source form of the work excluding those notices that do not pertain to any part of the derivative works and d "
        "if the work includes a notice text file as part of its distribution then any derivative works that you "
        "distribute must include a readable copy of the attribution notices contained within such notice file excluding "
        "those notices that do not pertain to any part of the derivative works in at least one of the following places "
        "within a notice text file distributed as part of the derivative works within the source form or documentation "
        "if provided along with the derivative works or within a display generated by the derivative works if and "
        "wherever such third party notices normally appear the contents of the notice file are for informational "
        "purposes only and do not modify the license you may add your own attribution notices within derivative works "
        "that you distribute alongside or as an addendum to the notice text from the work provided that such additional "
        "attribution notices cannot be construed as modifying the license you may add your own copyright statement to "
        "your modifications and may provide additional or different license terms and conditions for use reproduction "
        "or distribution of your modifications or for any such derivative works as a whole provided your use "
        "reproduction and distribution of the work otherwise complies with the conditions stated in this license 5 "
        "submission of contributions unless you explicitly state otherwise any contribution intentionally submitted for "
        "inclusion in the work by you to the licensor shall be under the terms and conditions of this license without "
        "any additional terms or conditions notwithstanding the above nothing herein shall supersede or modify the "
        "terms of any separate license agreement you may have executed with licensor regarding such contributions 6 "
        "trademarks this license does not grant permission to use the trade names trademarks service marks or product "
        "names of the licensor except as required for reasonable and customary use in describing the origin of the work "
        "and reproducing the content of the notice file 7 disclaimer of warranty unless required by applicable law or "
        "agreed to in writing licensor provides the work and each contributor provides its contributions on an as is "
        "basis without warranties or conditions of any kind either express or implied including without limitation any "
        "warranties or conditions of title non infringement merchantability or fitness for a particular purpose you are "
        "solely responsible for determining the appropriateness of using or redistributing the work and assume any "
        "risks associated with your exercise of permissions under this license 8 limitation of liability in no event "
        "and under no legal theory whether in tort including negligence contract or otherwise unless required by "
        "applicable law such as deliberate and grossly negligent acts or agreed to in writing shall any contributor be "
        "liable to you for damages including any direct indirect special incidental or consequential damages of any "
        "character arising as a result of this license or out of the use or inability to use the work including but not "
        "limited to damages for loss of goodwill work stoppage computer failure or malfunction or any and all other "
        "commercial damages or losses even if such contributor has been advised of the possibility of such damages 9 "
        "accepting warranty or additional liability while redistributing the work or derivative works thereof you may "
        "choose to offer and charge a fee for acceptance of support warranty indemnity or other liability obligations "
        "and or rights consistent with this license however in accepting such obligations you may act only on your own "
        "behalf and on your sole responsibility not on behalf of any other contributor and only if you agree to "
        "indemnify defend and hold each contributor harmless for any liability incurred by or claims asserted against "
        "such contributor by reason of your accepting any such warranty or additional liability end of terms and "
        "conditions appendix how to apply the apache license to your work to apply the apache license to your work "
        "attach the following boilerplate notice with the fields enclosed by brackets replaced with your own "
        "identifying information don t include the brackets the text should be enclosed in the appropriate comment "
        "syntax for the file format we also recommend that a file or class name and description of purpose be included "
        "on the same printed page as the copyright notice for easier identification within third party archives "
        "copyright yyyy name of copyright owner licensed under the apache license version 2 0 the license you may not "
        "use this file except in compliance with the license you may obtain a copy of the license at http www apache "
        "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either express or "
        "implied see the license for the specific language governing permissions and limitations under the license "
    ),
    "BSD-2-Clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution this software is provided by the copyright holders and contributors as is and "
        "any express or implied warranties including but not limited to the implied warranties of merchantability and "
        "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be "
        "liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
        "to procurement of substitute goods or services loss of use data or profits or business interruption however "
        "caused and on any theory of liability whether in contract strict liability or tort including negligence or "
        "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage "
    ),
    "BSD-3-Clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
        "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
        "notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors "
        "may be used to endorse or promote products derived from this software without specific prior written "
        "permission this software is provided by the copyright holders and contributors as is and any express or "
        "implied warranties including but not limited to the implied warranties of merchantability and fitness for a "
        "particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any "
        "direct indirect incidental special exemplary or consequential damages including but not limited to procurement "
        "of substitute goods or services loss of use data or profits or business interruption however caused and on any "
        "theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
        "any way out of the use of this software even if advised of the possibility of such damage "
    ),
    "CC0-1.0": (
        "creative commons legal code cc0 1 0 universal creative commons corporation is not a law firm and does not "
        "provide legal services distribution of this document does not create an attorney client relationship creative "
        "commons provides this information on an as is basis creative commons makes no warranties regarding the use of "
        "this document or the information or works provided hereunder and disclaims liability for damages resulting "
        "from the use of this document or the information or works provided hereunder statement of purpose the laws of "
        "most jurisdictions throughout the world automatically confer exclusive copyright and related rights defined "
        "below upon the creator and subsequent owner s each and all an owner of an original work of authorship and or a "
        "database each a work certain owners wish to permanently relinquish those rights to a work for the purpose of "
        "contributing to a commons of creative cultural and scientific works commons that the public can reliably and "
        "without fear of later claims of infringement build upon modify incorporate in other works reuse and "
        "redistribute as freely as possible in any form whatsoever and for any purposes including without limitation "
        "commercial purposes these owners may contribute to the commons to promote the ideal of a free culture and the "
        "further production of creative cultural and scientific works or to gain reputation or greater distribution for "
        "their work in part through the use and efforts of others for these and or other purposes and motivations and "
        "without any expectation of additional consideration or compensation the person associating cc0 with a work the "
        "affirmer to the extent that he or she is an owner of copyright and related rights in the work voluntarily "
        "elects to apply cc0 to the work and publicly distribute the work under its terms with knowledge of his or her "
        "copyright and related rights in the work and the meaning and intended legal effect of cc0 on those rights 1 "
        "copyright and related rights a work made available under cc0 may be protected by copyright and related or "
        "neighboring rights copyright and related rights copyright and related rights include but are not limited to "
        "the following i the right to reproduce adapt distribute perform display communicate and translate a work ii "
        "moral rights retained by the original author s and or performer s iii publicity and privacy rights pertaining "
        "to a person s image or likeness depicted in a work iv rights protecting against unfair competition in regards "
        "to a work subject to the limitations in paragraph 4 a below v rights protecting the extraction dissemination "
        "use and reuse of data in a work vi database rights such as those arising under directive 96 9 ec of the "
        "european parliament and of the council of 11 march 1996 on the legal protection of databases and under any "
        "national implementation thereof including any amended or successor version of such directive and vii other "
        "similar equivalent or corresponding rights throughout the world based on applicable law or treaty and any "
        "national implementations thereof 2 waiver to the greatest extent permitted by but not in contravention of "
        "applicable law affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and "
        "surrenders all of affirmer s copyright and related rights and associated claims and causes of action whether "
        "now known or unknown including existing as well as future claims and causes of action in the work i in all "
        "territories worldwide ii for the maximum duration provided by applicable law or treaty including future time "
        "extensions iii in any current or future medium and for any number of copies and iv for any purpose whatsoever "
        "including without limitation commercial advertising or promotional purposes the waiver affirmer makes the "
        "waiver for the benefit of each member of the public at large and to the detriment of affirmer s heirs and "
        "successors fully intending that such waiver shall not be subject to revocation rescission cancellation "
        "termination or any other legal or equitable action to disrupt the quiet enjoyment of the work by the public as "
        "contemplated by affirmer s express statement of purpose 3 public license fallback should any part of the "
        "waiver for any reason be judged legally invalid or ineffective under applicable law then the waiver shall be "
        "preserved to the maximum extent permitted taking into account affirmer s express statement of purpose in "
        "addition to the extent the waiver is so judged affirmer hereby grants to each affected person a royalty free "
        "non transferable non sublicensable non exclusive irrevocable and unconditional license to exercise affirmer s "
        "copyright and related rights in the work i in all territories worldwide ii for the maximum duration provided "
        "by applicable law or treaty including future time extensions iii in any current or future medium and for any "
        "number of copies and iv for any purpose whatsoever including without limitation commercial advertising or "
        "promotional purposes the license the license shall be deemed effective as of the date cc0 was applied by "
        "affirmer to the work should any part of the license for any reason be judged legally invalid or ineffective "
        "under applicable law such partial invalidity or ineffectiveness shall not invalidate the remainder of the "
        "license and in such case affirmer hereby affirms that he or she will not i exercise any of his or her "
        "remaining copyright and related rights in the work or ii assert any associated claims and causes of action "
        "with respect to the work in either case contrary to affirmer s express statement of purpose 4 limitations and "
        "disclaimers a no trademark or patent rights held by affirmer are waived abandoned surrendered licensed or "
        "otherwise affected by this document b affirmer offers the work as is and makes no representations or "
        "warranties of any kind concerning the work express implied statutory or otherwise including without limitation "
        "warranties of title merchantability fitness for a particular purpose non infringement or the absence of latent "
        "or other defects accuracy or the present or absence of errors whether or not discoverable all to the greatest "
        "extent permissible under applicable law c affirmer disclaims responsibility for clearing rights of other "
        "persons that may apply to the work or any use thereof including without limitation any person s copyright and "
        "related rights in the work further affirmer disclaims responsibility for obtaining any necessary consents "
        "permissions or other rights required for any use of the work d affirmer understands and acknowledges that "
        "creative commons is not a party to this document and has no duty or obligation with respect to this cc0 or use "
        "of the work "
    ),
    "GPL-2.0": (
        "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc 51 franklin "
        "street fifth floor boston ma 02110 1301 usa everyone is permitted to copy and distribute verbatim copies of "
        "this license document but changing it is not allowed preamble the licenses for most software are designed to "
        "take away your freedom to share and change it by contrast the gnu general public license is intended to "
        "guarantee your freedom to share and change free software to make sure the software is free for all its users "
        "this general public license applies to most of the free software foundation s software and to any other "
        "program whose authors commit to using it some other free software foundation software is covered by the gnu "
        "lesser general public license instead you can apply it to your programs too when we speak of free software we "
        "are referring to freedom not price our general public licenses are designed to make sure that you have the "
        "freedom to distribute copies of free software and charge for this service if you wish that you receive source "
        "code or can get it if you want it that you can change the software or use pieces of it in new free programs "
        "and that you know you can do these things to protect your rights we need to make restrictions that forbid "
        "anyone to deny you these rights or to ask you to surrender the rights these restrictions translate to certain "
        "responsibilities for you if you distribute copies of the software or if you modify it for example if you "
        "distribute copies of such a program whether gratis or for a fee you must give the recipients all the rights "
        "that you have you must make sure that they too receive or can get the source code and you must show them these "
        "terms so they know their rights we protect your rights with two steps 1 copyright the software and 2 offer you "
        "this license which gives you legal permission to copy distribute and or modify the software also for each "
        "author s protection and ours we want to make certain that everyone understands that there is no warranty for "
        "this free software if the software is modified by someone else and passed on we want its recipients to know "
        "that what they have is not the original so that any problems introduced by others will not reflect on the "
        "original authors reputations finally any free program is threatened constantly by software patents we wish to "
        "avoid the danger that redistributors of a free program will individually obtain patent licenses in effect "
        "making the program proprietary to prevent this we have made it clear that any patent must be licensed for "
        "everyone s free use or not licensed at all the precise terms and conditions for copying distribution and "
        "modification follow gnu general public license terms and conditions for copying distribution and modification "
        "0 this license applies to any program or other work which contains a notice placed by the copyright holder "
        "saying it may be distributed under the terms of this general public license the program below refers to any "
        "such program or work and a work based on the program means either the program or any derivative work under "
        "copyright law that is to say a work containing the program or a portion of it either verbatim or with "
        "modifications and or translated into another language hereinafter translation is included without limitation "
        "in the term modification each licensee is addressed as you activities other than copying distribution and "
        "modification are not covered by this license they are outside its scope the act of running the program is not "
        "restricted and the output from the program is covered only if its contents constitute a work based on the "
        "program independent of having been made by running the program whether that is true depends on what the "
        "program does 1 you may copy and distribute verbatim copies of the program s source code as you receive it in "
        "any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright "
        "notice and disclaimer of warranty keep intact all the notices that refer to this license and to the absence of "
        "any warranty and give any other recipients of the program a copy of this license along with the program you "
        "may charge a fee for the physical act of transferring a copy and you may at your option offer warranty "
        "protection in exchange for a fee 2 you may modify your copy or copies of the program or any portion of it thus "
        "forming a work based on the program and copy and distribute such modifications or work under the terms of "
        "section 1 above provided that you also meet all of these conditions a you must cause the modified files to "
        "carry prominent notices stating that you changed the files and the date of any change b you must cause any "
        "work that you distribute or publish that in whole or in part contains or is derived from the program or any "
        "part thereof to be licensed as a whole at no charge to all third parties under the terms of this license c if "
        "the modified program normally reads commands interactively when run you must cause it when started running for "
        "such interactive use in the most ordinary way to print or display an announcement including an appropriate "
        "copyright notice and a notice that there is no warranty or else saying that you provide a warranty and that "
        "users may redistribute the program under these conditions and telling the user how to view a copy of this "
        "license exception if the program itself is interactive but does not normally print such an announcement your "
        "work based on the program is not required to print an announcement these requirements apply to the modified "
        "work as a whole if identifiable sections of that work are not derived from the program and can be reasonably "
        "considered independent and separate works in themselves then this license and its terms do not apply to those "
        "sections when you distribute them as separate works but when you distribute the same sections as part of a "
        "whole which is a work based on the program the distribution of the whole must be on the terms of this license "
        "whose permissions for other licensees extend to the entire whole and thus to each and every part regardless of "
        "who wrote it thus it is not the intent of this section to claim rights or contest your rights to work written "
        "entirely by you rather the intent is to exercise the right to control the distribution of derivative or "
        "collective works based on the program in addition mere aggregation of another work not based on the program "
        "with the program or with a work based on the program on a volume of a storage or distribution medium does not "
        "bring the other work under the scope of this license 3 you may copy and distribute the program or a work based "
        "on it under section 2 in object code or executable form under the terms of sections 1 and 2 above provided "
        "that you also do one of the following a accompany it with the complete corresponding machine readable source "
        "code which must be distributed under the terms of sections 1 and 2 above on a medium customarily used for "
        "software interchange or b accompany it with a written offer valid for at least three years to give any third "
        "party for a charge no more than your cost of physically performing source distribution a complete machine "
        "readable copy of the corresponding source code to be distributed under the terms of sections 1 and 2 above on "
        "a medium customarily used for software interchange or c accompany it with the information you received as to "
        "the offer to distribute corresponding source code this alternative is allowed only for noncommercial "
        "distribution and only if you received the program in object code or executable form with such an offer in "
        "accord with subsection b above the source code for a work means the preferred form of the work for making "
        "modifications to it for an executable work complete source code means all the source code for all modules it "
        "contains plus any associated interface definition files plus the scripts used to control compilation and "
        "installation of the executable however as a special exception the source code distributed need not include "
        "anything that is normally distributed in either source or binary form with the major components compiler "
        "kernel and so on of the operating system on which the executable runs unless that component itself accompanies "
        "the executable if distribution of executable or object code is made by offering access to copy from a "
        "designated place then offering equivalent access to copy the source code from the same place counts as "
        "distribution of the source code even though third parties are not compelled to copy the source along with the "
        "object code 4 you may not copy modify sublicense or distribute the program except as expressly provided under "
        "this license any attempt otherwise to copy modify sublicense or distribute the program is void and will "
        "automatically terminate your rights under this license however parties who have received copies or rights from "
        "you under this license will not have their licenses terminated so long as such parties remain in full "
        "compliance 5 you are not required to accept this license since you have not signed it however nothing else "
        "grants you permission to modify or distribute the program or its derivative works these actions are prohibited "
        "by law if you do not accept this license therefore by modifying or distributing the program or any work based "
        "on the program you indicate your acceptance of this license to do so and all its terms and conditions for "
        "copying distributing or modifying the program or works based on it 6 each time you redistribute the program or "
        "any work based on the program the recipient automatically receives a license from the original licensor to "
        "copy distribute or modify the program subject to these terms and conditions you may not impose any further "
        "restrictions on the recipients exercise of the rights granted herein you are not responsible for enforcing "
        "compliance by third parties to this license 7 if as a consequence of a court judgment or allegation of patent "
        "infringement or for any other reason not limited to patent issues conditions are imposed on you whether by "
        "court order agreement or otherwise that contradict the conditions of this license they do not excuse you from "
        "the conditions of this license if you cannot distribute so as to satisfy simultaneously your obligations under "
        "this license and any other pertinent obligations then as a consequence you may not distribute the program at "
        "all for example if a patent license would not permit royalty free redistribution of the program by all those "
        "who receive copies directly or indirectly through you then the only way you could satisfy both it and this "
        "license would be to refrain entirely from distribution of the program if any portion of this section is held "
        "invalid or unenforceable under any particular circumstance the balance of the section is intended to apply and "
        "the section as a whole is intended to apply in other circumstances it is not the purpose of this section to "
        "induce you to infringe any patents or other property right claims or to contest validity of any such claims "
        "this section has the sole purpose of protecting the integrity of the free software distribution system which "
        "is implemented by public license practices many people have made generous contributions to the wide range of "
        "software distributed through that system in reliance on consistent application of that system it is up to the "
        "author donor to decide if he or she is willing to distribute software through any other system and a licensee "
        "cannot impose that choice this section is intended to make thoroughly clear what is believed to be a "
        "consequence of the rest of this license 8 if the distribution and or use of the program is restricted in "
        "certain countries either by patents or by copyrighted interfaces the original copyright holder who places the "
        "program under this license may add an explicit geographical distribution limitation excluding those countries "
        "so that distribution is permitted only in or among countries not thus excluded in such case this license "
        "incorporates the limitation as if written in the body of this license 9 the free software foundation may "
        "publish revised and or new versions of the general public license from time to time such new versions will be "
        "similar in spirit to the present version but may differ in detail to address new problems or concerns each "
        "version is given a distinguishing version number if the program specifies a version number of this license "
        "which applies to it and any later version you have the option of following the terms and conditions either of "
        "that version or of any later version published by the free software foundation if the program does not specify "
        "a version number of this license you may choose any version ever published by the free software foundation 10 "
        "if you wish to incorporate parts of the program into other free programs whose distribution conditions are "
        "different write to the author to ask for permission for software which is copyrighted by the free software "
        "foundation write to the free software foundation we sometimes make exceptions for this our decision will be "
        "guided by the two goals of preserving the free status of all derivatives of our free software and of promoting "
        "the sharing and reuse of software generally no warranty 11 because the program is licensed free of charge "
        "there is no warranty for the program to the extent permitted by applicable law except when otherwise stated in "
        "writing the copyright holders and or other parties provide the program as is without warranty of any kind "
        "either expressed or implied including but not limited to the implied warranties of merchantability and fitness "
        "for a particular purpose the entire risk as to the quality and performance of the program is with you should "
        "the program prove defective you assume the cost of all necessary servicing repair or correction 12 in no event "
        "unless required by applicable law or agreed to in writing will any copyright holder or any other party who may "
        "modify and or redistribute the program as permitted above be liable to you for damages including any general "
        "special incidental or consequential damages arising out of the use or inability to use the program including "
        "but not limited to loss of data or data being rendered inaccurate or losses sustained by you or third parties "
        "or a failure of the program to operate with any other programs even if such holder or other party has been "
        "advised of the possibility of such damages end of terms and conditions how to apply these terms to your new "
        "programs if you develop a new program and you want it to be of the greatest possible use to the public the "
        "best way to achieve this is to make it free software which everyone can redistribute and change under these "
        "terms to do so attach the following notices to the program it is safest to attach them to the start of each "
        "source file to most effectively convey the exclusion of warranty and each file should have at least the "
        "copyright line and a pointer to where the full notice is found one line to give the program s name and a brief "
        "idea of what it does copyright c year name of author this program is free software you can redistribute it and "
        "or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version this program is distributed in the hope "
        "that it will be useful but without any warranty without even the implied warranty of merchantability or "
        "fitness for a particular purpose see the gnu general public license for more details you should have received "
        "a copy of the gnu general public license along with this program if not write to the free software foundation "
        "inc 51 franklin street fifth floor boston ma 02110 1301 usa also add information on how to contact you by "
        "electronic and paper mail if the program is interactive make it output a short notice like this when it starts "
        "in an interactive mode gnomovision version 69 copyright c year name of author gnomovision comes with "
        "absolutely no warranty for details type show w this is free software and you are welcome to redistribute it "
        "under certain conditions type show c for details the hypothetical commands show w and show c should show the "
        "appropriate parts of the general public license of course the commands you use may be called something other "
        "than show w and show c they could even be mouse clicks or menu items whatever suits your program you should "
        "also get your employer if you work as a programmer or your school if any to sign a copyright disclaimer for "
        "the program if necessary here is a sample alter the names yoyodyne inc hereby disclaims all copyright interest "
        "in the program gnomovision which makes passes at compilers written by james hacker signature of ty coon 1 "
        "april 1989 ty coon president of vice this general public license does not permit incorporating your program "
        "into proprietary programs if your program is a subroutine library you may consider it more useful to permit "
        "linking proprietary applications with the library if this is what you want to do use the gnu lesser general "
        "public license instead of this license "
    ),
    "GPL-3.0": (
        "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https fsf org "
        "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not "
        "allowed preamble the gnu general public license is a free copyleft license for software and other kinds of "
        "works the licenses for most software and other practical works are designed to take away your freedom to share "
        "and change the works by contrast the gnu general public license is intended to guarantee your freedom to share "
        "and change all versions of a program to make sure it remains free software for all its users we the free "
        "software foundation use the gnu general public license for most of our software it applies also to any other "
        "work released this way by its authors you can apply it to your programs too when we speak of free software we "
        "are referring to freedom not price our general public licenses are designed to make sure that you have the "
        "freedom to distribute copies of free software and charge for them if you wish that you receive source code or "
        "can get it if you want it that you can change the software or use pieces of it in new free programs and that "
        "you know you can do these things to protect your rights we need to prevent others from denying you these "
        "rights or asking you to surrender the rights therefore you have certain responsibilities if you distribute "
        "copies of the software or if you modify it responsibilities to respect the freedom of others for example if "
        "you distribute copies of such a program whether gratis or for a fee you must pass on to the recipients the "
        "same freedoms that you received you must make sure that they too receive or can get the source code and you "
        "must show them these terms so they know their rights developers that use the gnu gpl protect your rights with "
        "two steps 1 assert copyright on the software and 2 offer you this license giving you legal permission to copy "
        "distribute and or modify it for the developers and authors protection the gpl clearly explains that there is "
        "no warranty for this free software for both users and authors sake the gpl requires that modified versions be "
        "marked as changed so that their problems will not be attributed erroneously to authors of previous versions "
        "some devices are designed to deny users access to install or run modified versions of the software inside them "
        "although the manufacturer can do so this is fundamentally incompatible with the aim of protecting users "
        "freedom to change the software the systematic pattern of such abuse occurs in the area of products for "
        "individuals to use which is precisely where it is most unacceptable therefore we have designed this version of "
        "the gpl to prohibit the practice for those products if such problems arise substantially in other domains we "
        "stand ready to extend this provision to those domains in future versions of the gpl as needed to protect the "
        "freedom of users finally every program is threatened constantly by software patents states should not allow "
        "patents to restrict development and use of software on general purpose computers but in those that do we wish "
        "to avoid the special danger that patents applied to a free program could make it effectively proprietary to "
        "prevent this the gpl assures that patents cannot be used to render the program non free the precise terms and "
        "conditions for copying distribution and modification follow terms and conditions 0 definitions this license "
        "refers to version 3 of the gnu general public license copyright also means copyright like laws that apply to "
        "other kinds of works such as semiconductor masks the program refers to any copyrightable work licensed under "
        "this license each licensee is addressed as you licensees and recipients may be individuals or organizations to "
        "modify a work means to copy from or adapt all or part of the work in a fashion requiring copyright permission "
        "other than the making of an exact copy the resulting work is called a modified version of the earlier work or "
        "a work based on the earlier work a covered work means either the unmodified program or a work based on the "
        "program to propagate a work means to do anything with it that without permission would make you directly or "
        "secondarily liable for infringement under applicable copyright law except executing it on a computer or "
        "modifying a private copy propagation includes copying distribution with or without modification making "
        "available to the public and in some countries other activities as well to convey a work means any kind of "
        "propagation that enables other parties to make or receive copies mere interaction with a user through a "
        "computer network with no transfer of a copy is not conveying an interactive user interface displays "
        "appropriate legal notices to the extent that it includes a convenient and prominently visible feature that 1 "
        "displays an appropriate copyright notice and 2 tells the user that there is no warranty for the work except to "
        "the extent that warranties are provided that licensees may convey the work under this license and how to view "
        "a copy of this license if the interface presents a list of user commands or options such as a menu a prominent "
        "item in the list meets this criterion 1 source code the source code for a work means the preferred form of the "
        "work for making modifications to it object code means any non source form of a work a standard interface means "
        "an interface that either is an official standard defined by a recognized standards body or in the case of "
        "interfaces specified for a particular programming language one that is widely used among developers working in "
        "that language the system libraries of an executable work include anything other than the work as a whole that "
        "a is included in the normal form of packaging a major component but which is not part of that major component "
        "and b serves only to enable use of the work with that major component or to implement a standard interface for "
        "which an implementation is available to the public in source code form a major component in this context means "
        "a major essential component kernel window system and so on of the specific operating system if any on which "
        "the executable work runs or a compiler used to produce the work or an object code interpreter used to run it "
        "the corresponding source for a work in object code form means all the source code needed to generate install "
        "and for an executable work run the object code and to modify the work including scripts to control those "
        "activities however it does not include the work s system libraries or general purpose tools or generally "
        "available free programs which are used unmodified in performing those activities but which are not part of the "
        "work for example corresponding source includes interface definition files associated with source files for the "
        "work and the source code for shared libraries and dynamically linked subprograms that the work is specifically "
        "designed to require such as by intimate data communication or control flow between those subprograms and other "
        "parts of the work the corresponding source need not include anything that users can regenerate automatically "
        "from other parts of the corresponding source the corresponding source for a work in source code form is that "
        "same work 2 basic permissions all rights granted under this license are granted for the term of copyright on "
        "the program and are irrevocable provided the stated conditions are met this license explicitly affirms your "
        "unlimited permission to run the unmodified program the output from running a covered work is covered by this "
        "license only if the output given its content constitutes a covered work this license acknowledges your rights "
        "of fair use or other equivalent as provided by copyright law you may make run and propagate covered works that "
        "you do not convey without conditions so long as your license otherwise remains in force you may convey covered "
        "works to others for the sole purpose of having them make modifications exclusively for you or provide you with "
        "facilities for running those works provided that you comply with the terms of this license in conveying all "
        "material for which you do not control copyright those thus making or running the covered works for you must do "
        "so exclusively on your behalf under your direction and control on terms that prohibit them from making any "
        "copies of your copyrighted material outside their relationship with you conveying under any other "
        "circumstances is permitted solely under the conditions stated below sublicensing is not allowed section 10 "
        "makes it unnecessary 3 protecting users legal rights from anti circumvention law no covered work shall be "
        "deemed part of an effective technological measure under any applicable law fulfilling obligations under "
        "article 11 of the wipo copyright treaty adopted on 20 december 1996 or similar laws prohibiting or restricting "
        "circumvention of such measures when you convey a covered work you waive any legal power to forbid "
        "circumvention of technological measures to the extent such circumvention is effected by exercising rights "
        "under this license with respect to the covered work and you disclaim any intention to limit operation or "
        "modification of the work as a means of enforcing against the work s users your or third parties legal rights "
        "to forbid circumvention of technological measures 4 conveying verbatim copies you may convey verbatim copies "
        "of the program s source code as you receive it in any medium provided that you conspicuously and appropriately "
        "publish on each copy an appropriate copyright notice keep intact all notices stating that this license and any "
        "non permissive terms added in accord with section 7 apply to the code keep intact all notices of the absence "
        "of any warranty and give all recipients a copy of this license along with the program you may charge any price "
        "or no price for each copy that you convey and you may offer support or warranty protection for a fee 5 "
        "conveying modified source versions you may convey a work based on the program or the modifications to produce "
        "it from the program in the form of source code under the terms of section 4 provided that you also meet all of "
        "these conditions a the work must carry prominent notices stating that you modified it and giving a relevant "
        "date b the work must carry prominent notices stating that it is released under this license and any conditions "
        "added under section 7 this requirement modifies the requirement in section 4 to keep intact all notices c you "
        "must license the entire work as a whole under this license to anyone who comes into possession of a copy this "
        "license will therefore apply along with any applicable section 7 additional terms to the whole of the work and "
        "all its parts regardless of how they are packaged this license gives no permission to license the work in any "
        "other way but it does not invalidate such permission if you have separately received it d if the work has "
        "interactive user interfaces each must display appropriate legal notices however if the program has interactive "
        "interfaces that do not display appropriate legal notices your work need not make them do so a compilation of a "
        "covered work with other separate and independent works which are not by their nature extensions of the covered "
        "work and which are not combined with it such as to form a larger program in or on a volume of a storage or "
        "distribution medium is called an aggregate if the compilation and its resulting copyright are not used to "
        "limit the access or legal rights of the compilation s users beyond what the individual works permit inclusion "
        "of a covered work in an aggregate does not cause this license to apply to the other parts of the aggregate 6 "
        "conveying non source forms you may convey a covered work in object code form under the terms of sections 4 and "
        "5 provided that you also convey the machine readable corresponding source under the terms of this license in "
        "one of these ways a convey the object code in or embodied in a physical product including a physical "
        "distribution medium accompanied by the corresponding source fixed on a durable physical medium customarily "
        "used for software interchange b convey the object code in or embodied in a physical product including a "
        "physical distribution medium accompanied by a written offer valid for at least three years and valid for as "
        "long as you offer spare parts or customer support for that product model to give anyone who possesses the "
        "object code either 1 a copy of the corresponding source for all the software in the product that is covered by "
        "this license on a durable physical medium customarily used for software interchange for a price no more than "
        "your reasonable cost of physically performing this conveying of source or 2 access to copy the corresponding "
        "source from a network server at no charge c convey individual copies of the object code with a copy of the "
        "written offer to provide the corresponding source this alternative is allowed only occasionally and "
        "noncommercially and only if you received the object code with such an offer in accord with subsection 6b d "
        "convey the object code by offering access from a designated place gratis or for a charge and offer equivalent "
        "access to the corresponding source in the same way through the same place at no further charge you need not "
        "require recipients to copy the corresponding source along with the object code if the place to copy the object "
        "code is a network server the corresponding source may be on a different server operated by you or a third "
        "party that supports equivalent copying facilities provided you maintain clear directions next to the object "
        "code saying where to find the corresponding source regardless of what server hosts the corresponding source "
        "you remain obligated to ensure that it is available for as long as needed to satisfy these requirements e "
        "convey the object code using peer to peer transmission provided you inform other peers where the object code "
        "and corresponding source of the work are being offered to the general public at no charge under subsection 6d "
        "a separable portion of the object code whose source code is excluded from the corresponding source as a system "
        "library need not be included in conveying the object code work a user product is either 1 a consumer product "
        "which means any tangible personal property which is normally used for personal family or household purposes or "
        "2 anything designed or sold for incorporation into a dwelling in determining whether a product is a consumer "
        "product doubtful cases shall be resolved in favor of coverage for a particular product received by a "
        "particular user normally used refers to a typical or common use of that class of product regardless of the "
        "status of the particular user or of the way in which the particular user actually uses or expects or is "
        "expected to use the product a product is a consumer product regardless of whether the product has substantial "
        "commercial industrial or non consumer uses unless such uses represent the only significant mode of use of the "
        "product installation information for a user product means any methods procedures authorization keys or other "
        "information required to install and execute modified versions of a covered work in that user product from a "
        "modified version of its corresponding source the information must suffice to ensure that the continued "
        "functioning of the modified object code is in no case prevented or interfered with solely because modification "
        "has been made if you convey an object code work under this section in or with or specifically for use in a "
        "user product and the conveying occurs as part of a transaction in which the right of possession and use of the "
        "user product is transferred to the recipient in perpetuity or for a fixed term regardless of how the "
        "transaction is characterized the corresponding source conveyed under this section must be accompanied by the "
        "installation information but this requirement does not apply if neither you nor any third party retains the "
        "ability to install modified object code on the user product for example the work has been installed in rom the "
        "requirement to provide installation information does not include a requirement to continue to provide support "
        "service warranty or updates for a work that has been modified or installed by the recipient or for the user "
        "product in which it has been modified or installed access to a network may be denied when the modification "
        "itself materially and adversely affects the operation of the network or violates the rules and protocols for "
        "communication across the network corresponding source conveyed and installation information provided in accord "
        "with this section must be in a format that is publicly documented and with an implementation available to the "
        "public in source code form and must require no special password or key for unpacking reading or copying 7 "
        "additional terms additional permissions are terms that supplement the terms of this license by making "
        "exceptions from one or more of its conditions additional permissions that are applicable to the entire program "
        "shall be treated as though they were included in this license to the extent that they are valid under "
        "applicable law if additional permissions apply only to part of the program that part may be used separately "
        "under those permissions but the entire program remains governed by this license without regard to the "
        "additional permissions when you convey a copy of a covered work you may at your option remove any additional "
        "permissions from that copy or from any part of it additional permissions may be written to require their own "
        "removal in certain cases when you modify the work you may place additional permissions on material added by "
        "you to a covered work for which you have or can give appropriate copyright permission notwithstanding any "
        "other provision of this license for material you add to a covered work you may if authorized by the copyright "
        "holders of that material supplement the terms of this license with terms a disclaiming warranty or limiting "
        "liability differently from the terms of sections 15 and 16 of this license or b requiring preservation of "
        "specified reasonable legal notices or author attributions in that material or in the appropriate legal notices "
        "displayed by works containing it or c prohibiting misrepresentation of the origin of that material or "
        "requiring that modified versions of such material be marked in reasonable ways as different from the original "
        "version or d limiting the use for publicity purposes of names of licensors or authors of the material or e "
        "declining to grant rights under trademark law for use of some trade names trademarks or service marks or f "
        "requiring indemnification of licensors and authors of that material by anyone who conveys the material or "
        "modified versions of it with contractual assumptions of liability to the recipient for any liability that "
        "these contractual assumptions directly impose on those licensors and authors all other non permissive "
        "additional terms are considered further restrictions within the meaning of section 10 if the program as you "
        "received it or any part of it contains a notice stating that it is governed by this license along with a term "
        "that is a further restriction you may remove that term if a license document contains a further restriction "
        "but permits relicensing or conveying under this license you may add to a covered work material governed by the "
        "terms of that license document provided that the further restriction does not survive such relicensing or "
        "conveying if you add terms to a covered work in accord with this section you must place in the relevant source "
        "files a statement of the additional terms that apply to those files or a notice indicating where to find the "
        "applicable terms additional terms permissive or non permissive may be stated in the form of a separately "
        "written license or stated as exceptions the above requirements apply either way 8 termination you may not "
        "propagate or modify a covered work except as expressly provided under this license any attempt otherwise to "
        "propagate or modify it is void and will automatically terminate your rights under this license including any "
        "patent licenses granted under the third paragraph of section 11 however if you cease all violation of this "
        "license then your license from a particular copyright holder is reinstated a provisionally unless and until "
        "the copyright holder explicitly and finally terminates your license and b permanently if the copyright holder "
        "fails to notify you of the violation by some reasonable means prior to 60 days after the cessation moreover "
        "your license from a particular copyright holder is reinstated permanently if the copyright holder notifies you "
        "of the violation by some reasonable means this is the first time you have received notice of violation of this "
        "license for any work from that copyright holder and you cure the violation prior to 30 days after your receipt "
        "of the notice termination of your rights under this section does not terminate the licenses of parties who "
        "have received copies or rights from you under this license if your rights have been terminated and not "
        "permanently reinstated you do not qualify to receive new licenses for the same material under section 10 9 "
        "acceptance not required for having copies you are not required to accept this license in order to receive or "
        "run a copy of the program ancillary propagation of a covered work occurring solely as a consequence of using "
        "peer to peer transmission to receive a copy likewise does not require acceptance however nothing other than "
        "this license grants you permission to propagate or modify any covered work these actions infringe copyright if "
        "you do not accept this license therefore by modifying or propagating a covered work you indicate your "
        "acceptance of this license to do so 10 automatic licensing of downstream recipients each time you convey a "
        "covered work the recipient automatically receives a license from the original licensors to run modify and "
        "propagate that work subject to this license you are not responsible for enforcing compliance by third parties "
        "with this license an entity transaction is a transaction transferring control of an organization or "
        "substantially all assets of one or subdividing an organization or merging organizations if propagation of a "
        "covered work results from an entity transaction each party to that transaction who receives a copy of the work "
        "also receives whatever licenses to the work the party s predecessor in interest had or could give under the "
        "previous paragraph plus a right to possession of the corresponding source of the work from the predecessor in "
        "interest if the predecessor has it or can get it with reasonable efforts you may not impose any further "
        "restrictions on the exercise of the rights granted or affirmed under this license for example you may not "
        "impose a license fee royalty or other charge for exercise of rights granted under this license and you may not "
        "initiate litigation including a cross claim or counterclaim in a lawsuit alleging that any patent claim is "
        "infringed by making using selling offering for sale or importing the program or any portion of it 11 patents a "
        "contributor is a copyright holder who authorizes use under this license of the program or a work on which the "
        "program is based the work thus licensed is called the contributor s contributor version a contributor s "
        "essential patent claims are all patent claims owned or controlled by the contributor whether already acquired "
        "or hereafter acquired that would be infringed by some manner permitted by this license of making using or "
        "selling its contributor version but do not include claims that would be infringed only as a consequence of "
        "further modification of the contributor version for purposes of this definition control includes the right to "
        "grant patent sublicenses in a manner consistent with the requirements of this license each contributor grants "
        "you a non exclusive worldwide royalty free patent license under the contributor s essential patent claims to "
        "make use sell offer for sale import and otherwise run modify and propagate the contents of its contributor "
        "version in the following three paragraphs a patent license is any express agreement or commitment however "
        "denominated not to enforce a patent such as an express permission to practice a patent or covenant not to sue "
        "for patent infringement to grant such a patent license to a party means to make such an agreement or "
        "commitment not to enforce a patent against the party if you convey a covered work knowingly relying on a "
        "patent license and the corresponding source of the work is not available for anyone to copy free of charge and "
        "under the terms of this license through a publicly available network server or other readily accessible means "
        "then you must either 1 cause the corresponding source to be so available or 2 arrange to deprive yourself of "
        "the benefit of the patent license for this particular work or 3 arrange in a manner consistent with the "
        "requirements of this license to extend the patent license to downstream recipients knowingly relying means you "
        "have actual knowledge that but for the patent license your conveying the covered work in a country or your "
        "recipient s use of the covered work in a country would infringe one or more identifiable patents in that "
        "country that you have reason to believe are valid if pursuant to or in connection with a single transaction or "
        "arrangement you convey or propagate by procuring conveyance of a covered work and grant a patent license to "
        "some of the parties receiving the covered work authorizing them to use propagate modify or convey a specific "
        "copy of the covered work then the patent license you grant is automatically extended to all recipients of the "
        "covered work and works based on it a patent license is discriminatory if it does not include within the scope "
        "of its coverage prohibits the exercise of or is conditioned on the non exercise of one or more of the rights "
        "that are specifically granted under this license you may not convey a covered work if you are a party to an "
        "arrangement with a third party that is in the business of distributing software under which you make payment "
        "to the third party based on the extent of your activity of conveying the work and under which the third party "
        "grants to any of the parties who would receive the covered work from you a discriminatory patent license a in "
        "connection with copies of the covered work conveyed by you or copies made from those copies or b primarily for "
        "and in connection with specific products or compilations that contain the covered work unless you entered into "
        "that arrangement or that patent license was granted prior to 28 march 2007 nothing in this license shall be "
        "construed as excluding or limiting any implied license or other defenses to infringement that may otherwise be "
        "available to you under applicable patent law 12 no surrender of others freedom if conditions are imposed on "
        "you whether by court order agreement or otherwise that contradict the conditions of this license they do not "
        "excuse you from the conditions of this license if you cannot convey a covered work so as to satisfy "
        "simultaneously your obligations under this license and any other pertinent obligations then as a consequence "
        "you may not convey it at all for example if you agree to terms that obligate you to collect a royalty for "
        "further conveying from those to whom you convey the program the only way you could satisfy both those terms "
        "and this license would be to refrain entirely from conveying the program 13 use with the gnu affero general "
        "public license notwithstanding any other provision of this license you have permission to link or combine any "
        "covered work with a work licensed under version 3 of the gnu affero general public license into a single "
        "combined work and to convey the resulting work the terms of this license will continue to apply to the part "
        "which is the covered work but the special requirements of the gnu affero general public license section 13 "
        "concerning interaction through a network will apply to the combination as such 14 revised versions of this "
        "license the free software foundation may publish revised and or new versions of the gnu general public license "
        "from time to time such new versions will be similar in spirit to the present version but may differ in detail "
        "to address new problems or concerns each version is given a distinguishing version number if the program "
        "specifies that a certain numbered version of the gnu general public license or any later version applies to it "
        "you have the option of following the terms and conditions either of that numbered version or of any later "
        "version published by the free software foundation if the program does not specify a version number of the gnu "
        "general public license you may choose any version ever published by the free software foundation if the "
        "program specifies that a proxy can decide which future versions of the gnu general public license can be used "
        "that proxy s public statement of acceptance of a version permanently authorizes you to choose that version for "
        "the program later license versions may give you additional or different permissions however no additional "
        "obligations are imposed on any author or copyright holder as a result of your choosing to follow a later "
        "version 15 disclaimer of warranty there is no warranty for the program to the extent permitted by applicable "
        "law except when otherwise stated in writing the copyright holders and or other parties provide the program as "
        "is without warranty of any kind either expressed or implied including but not limited to the implied "
        "warranties of merchantability and fitness for a particular purpose the entire risk as to the quality and "
        "performance of the program is with you should the program prove defective you assume the cost of all necessary "
        "servicing repair or correction 16 limitation of liability in no event unless required by applicable law or "
        "agreed to in writing will any copyright holder or any other party who modifies and or conveys the program as "
        "permitted above be liable to you for damages including any general special incidental or consequential damages "
        "arising out of the use or inability to use the program including but not limited to loss of data or data being "
        "rendered inaccurate or losses sustained by you or third parties or a failure of the program to operate with "
        "any other programs even if such holder or other party has been advised of the possibility of such damages 17 "
        "interpretation of sections 15 and 16 if the disclaimer of warranty and limitation of liability provided above "
        "cannot be given local legal effect according to their terms reviewing courts shall apply local law that most "
        "closely approximates an absolute waiver of all civil liability in connection with the program unless a "
        "warranty or assumption of liability accompanies a copy of the program in return for a fee end of terms and "
        "conditions how to apply these terms to your new programs if you develop a new program and you want it to be of "
        "the greatest possible use to the public the best way to achieve this is to make it free software which "
        "everyone can redistribute and change under these terms to do so attach the following notices to the program it "
        "is safest to attach them to the start of each source file to most effectively state the exclusion of warranty "
        "and each file should have at least the copyright line and a pointer to where the full notice is found one line "
        "to give the program s name and a brief idea of what it does copyright c year name of author this program is "
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the "
        "implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for "
        "more details you should have received a copy of the gnu general public license along with this program if not "
        "see https www gnu org licenses also add information on how to contact you by electronic and paper mail if the "
        "program does terminal interaction make it output a short notice like this when it starts in an interactive "
        "mode program copyright c year name of author this program comes with absolutely no warranty for details type "
        "show w this is free software and you are welcome to redistribute it under certain conditions type show c for "
        "details the hypothetical commands show w and show c should show the appropriate parts of the general public "
        "license of course your program s commands might be different for a gui interface you would use an about box "
        "you should also get your employer if you work as a programmer or school if any to sign a copyright disclaimer "
        "for the program if necessary for more information on this and how to apply and follow the gnu gpl see https "
        "www gnu org licenses the gnu general public license does not permit incorporating your program into "
        "proprietary programs if your program is a subroutine library you may consider it more useful to permit linking "
        "proprietary applications with the library if this is what you want to do use the gnu lesser general public "
        "license instead of this license but first please read https www gnu org licenses why not lgpl html "
    ),
    "ISC": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies the software "
        "is provided as is and the author disclaims all warranties with regard to this software including all implied "
        "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
        "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software "
    ),
    "LGPL-3.0": (
        "gnu lesser general public license version 3 29 june 2007 copyright c 2007 free software foundation inc https "
        "fsf org everyone is permitted to copy and distribute verbatim copies of this license document but changing it "
        "is not allowed this version of the gnu lesser general public license incorporates the terms and conditions of "
        "version 3 of the gnu general public license supplemented by the additional permissions listed below 0 "
        "additional definitions as used herein this license refers to version 3 of the gnu lesser general public "
        "license and the gnu gpl refers to version 3 of the gnu general public license the library refers to a covered "
        "work governed by this license other than an application or a combined work as defined below an application is "
        "any work that makes use of an interface provided by the library but which is not otherwise based on the "
        "library defining a subclass of a class defined by the library is deemed a mode of using an interface provided "
        "by the library a combined work is a work produced by combining or linking an application with the library the "
        "particular version of the library with which the combined work was made is also called the linked version the "
        "minimal corresponding source for a combined work means the corresponding source for the combined work "
        "excluding any source code for portions of the combined work that considered in isolation are based on the "
        "application and not on the linked version the corresponding application code for a combined work means the "
        "object code and or source code for the application including any data and utility programs needed for "
        "reproducing the combined work from the application but excluding the system libraries of the combined work 1 "
        "exception to section 3 of the gnu gpl you may convey a covered work under sections 3 and 4 of this license "
        "without being bound by section 3 of the gnu gpl 2 conveying modified versions if you modify a copy of the "
        "library and in your modifications a facility refers to a function or data to be supplied by an application "
        "that uses the facility other than as an argument passed when the facility is invoked then you may convey a "
        "copy of the modified version a under this license provided that you make a good faith effort to ensure that in "
        "the event an application does not supply the function or data the facility still operates and performs "
        "whatever part of its purpose remains meaningful or b under the gnu gpl with none of the additional permissions "
        "of this license applicable to that copy 3 object code incorporating material from library header files the "
        "object code form of an application may incorporate material from a header file that is part of the library you "
        "may convey such object code under terms of your choice provided that if the incorporated material is not "
        "limited to numerical parameters data structure layouts and accessors or small macros inline functions and "
        "templates ten or fewer lines in length you do both of the following a give prominent notice with each copy of "
        "the object code that the library is used in it and that the library and its use are covered by this license b "
        "accompany the object code with a copy of the gnu gpl and this license document 4 combined works you may convey "
        "a combined work under terms of your choice that taken together effectively do not restrict modification of the "
        "portions of the library contained in the combined work and reverse engineering for debugging such "
        "modifications if you also do each of the following a give prominent notice with each copy of the combined work "
        "that the library is used in it and that the library and its use are covered by this license b accompany the "
        "combined work with a copy of the gnu gpl and this license document c for a combined work that displays "
        "copyright notices during execution include the copyright notice for the library among these notices as well as "
        "a reference directing the user to the copies of the gnu gpl and this license document d do one of the "
        "following 0 convey the minimal corresponding source under the terms of this license and the corresponding "
        "application code in a form suitable for and under terms that permit the user to recombine or relink the "
        "application with a modified version of the linked version to produce a modified combined work in the manner "
        "specified by section 6 of the gnu gpl for conveying corresponding source 1 use a suitable shared library "
        "mechanism for linking with the library a suitable mechanism is one that a uses at run time a copy of the "
        "library already present on the user s computer system and b will operate properly with a modified version of "
        "the library that is interface compatible with the linked version e provide installation information but only "
        "if you would otherwise be required to provide such information under section 6 of the gnu gpl and only to the "
        "extent that such information is necessary to install and execute a modified version of the combined work "
        "produced by recombining or relinking the application with a modified version of the linked version if you use "
        "option 4d0 the installation information must accompany the minimal corresponding source and corresponding "
        "application code if you use option 4d1 you must provide the installation information in the manner specified "
        "by section 6 of the gnu gpl for conveying corresponding source 5 combined libraries you may place library "
        "facilities that are a work based on the library side by side in a single library together with other library "
        "facilities that are not applications and are not covered by this license and convey such a combined library "
        "under terms of your choice if you do both of the following a accompany the combined library with a copy of the "
        "same work based on the library uncombined with any other library facilities conveyed under the terms of this "
        "license b give prominent notice with the combined library that part of it is a work based on the library and "
        "explaining where to find the accompanying uncombined form of the same work 6 revised versions of the gnu "
        "lesser general public license the free software foundation may publish revised and or new versions of the gnu "
        "lesser general public license from time to time such new versions will be similar in spirit to the present "
        "version but may differ in detail to address new problems or concerns each version is given a distinguishing "
        "version number if the library as you received it specifies that a certain numbered version of the gnu lesser "
        "general public license or any later version applies to it you have the option of following the terms and "
        "conditions either of that published version or of any later version published by the free software foundation "
        "if the library as you received it does not specify a version number of the gnu lesser general public license "
        "you may choose any version of the gnu lesser general public license ever published by the free software "
        "foundation if the library as you received it specifies that a proxy can decide whether future versions of the "
        "gnu lesser general public license shall apply that proxy s public statement of acceptance of any version is "
        "permanent authorization for you to choose that version for the library "
    ),
    "MIT": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the "
        "authors or copyright holders be liable for any claim damages or other liability whether in an action of "
        "contract tort or otherwise arising from out of or in connection with the software or the use or other dealings "
        "in the software "
    ),
    "MPL-2.0": (
        "mozilla public license version 2 0 1 definitions 1 1 contributor means each individual or legal entity that "
        "creates contributes to the creation of or owns covered software 1 2 contributor version means the combination "
        "of the contributions of others if any used by a contributor and that particular contributor s contribution 1 3 "
        "contribution means covered software of a particular contributor 1 4 covered software means source code form to "
        "which the initial contributor has attached the notice in exhibit a the executable form of such source code "
        "form and modifications of such source code form in each case including portions thereof 1 5 incompatible with "
        "secondary licenses means a that the initial contributor has attached the notice described in exhibit b to the "
        "covered software or b that the covered software was made available under the terms of version 1 1 or earlier "
        "of the license but not also under the terms of a secondary license 1 6 executable form means any form of the "
        "work other than source code form 1 7 larger work means a work that combines covered software with other "
        "material in a separate file or files that is not covered software 1 8 license means this document 1 9 "
        "licensable means having the right to grant to the maximum extent possible whether at the time of the initial "
        "grant or subsequently any and all of the rights conveyed by this license 1 10 modifications means any of the "
        "following a any file in source code form that results from an addition to deletion from or modification of the "
        "contents of covered software or b any new file in source code form that contains any covered software 1 11 "
        "patent claims of a contributor means any patent claim s including without limitation method process and "
        "apparatus claims in any patent licensable by such contributor that would be infringed but for the grant of the "
        "license by the making using selling offering for sale having made import or transfer of either its "
        "contributions or its contributor version 1 12 secondary license means either the gnu general public license "
        "version 2 0 the gnu lesser general public license version 2 1 the gnu affero general public license version 3 "
        "0 or any later versions of those licenses 1 13 source code form means the form of the work preferred for "
        "making modifications 1 14 you or your means an individual or a legal entity exercising rights under this "
        "license for legal entities you includes any entity that controls is controlled by or is under common control "
        "with you for purposes of this definition control means a the power direct or indirect to cause the direction "
        "or management of such entity whether by contract or otherwise or b ownership of more than fifty percent 50 of "
        "the outstanding shares or beneficial ownership of such entity 2 license grants and conditions 2 1 grants each "
        "contributor hereby grants you a world wide royalty free non exclusive license a under intellectual property "
        "rights other than patent or trademark licensable by such contributor to use reproduce make available modify "
        "display perform distribute and otherwise exploit its contributions either on an unmodified basis with "
        "modifications or as part of a larger work and b under patent claims of such contributor to make use sell offer "
        "for sale have made import and otherwise transfer either its contributions or its contributor version 2 2 "
        "effective date the licenses granted in section 2 1 with respect to any contribution become effective for each "
        "contribution on the date the contributor first distributes such contribution 2 3 limitations on grant scope "
        "the licenses granted in this section 2 are the only rights granted under this license no additional rights or "
        "licenses will be implied from the distribution or licensing of covered software under this license "
        "notwithstanding section 2 1 b above no patent license is granted by a contributor a for any code that a "
        "contributor has removed from covered software or b for infringements caused by i your and any other third "
        "party s modifications of covered software or ii the combination of its contributions with other software "
        "except as part of its contributor version or c under patent claims infringed by covered software in the "
        "absence of its contributions this license does not grant any rights in the trademarks service marks or logos "
        "of any contributor except as may be necessary to comply with the notice requirements in section 3 4 2 4 "
        "subsequent licenses no contributor makes additional grants as a result of your choice to distribute the "
        "covered software under a subsequent version of this license see section 10 2 or under the terms of a secondary "
        "license if permitted under the terms of section 3 3 2 5 representation each contributor represents that the "
        "contributor believes its contributions are its original creation s or it has sufficient rights to grant the "
        "rights to its contributions conveyed by this license 2 6 fair use this license is not intended to limit any "
        "rights you have under applicable copyright doctrines of fair use fair dealing or other equivalents 2 7 "
        "conditions sections 3 1 3 2 3 3 and 3 4 are conditions of the licenses granted in section 2 1 3 "
        "responsibilities 3 1 distribution of source form all distribution of covered software in source code form "
        "including any modifications that you create or to which you contribute must be under the terms of this license "
        "you must inform recipients that the source code form of the covered software is governed by the terms of this "
        "license and how they can obtain a copy of this license you may not attempt to alter or restrict the recipients "
        "rights in the source code form 3 2 distribution of executable form if you distribute covered software in "
        "executable form then a such covered software must also be made available in source code form as described in "
        "section 3 1 and you must inform recipients of the executable form how they can obtain a copy of such source "
        "code form by reasonable means in a timely manner at a charge no more than the cost of distribution to the "
        "recipient and b you may distribute such executable form under the terms of this license or sublicense it under "
        "different terms provided that the license for the executable form does not attempt to limit or alter the "
        "recipients rights in the source code form under this license 3 3 distribution of a larger work you may create "
        "and distribute a larger work under terms of your choice provided that you also comply with the requirements of "
        "this license for the covered software if the larger work is a combination of covered software with a work "
        "governed by one or more secondary licenses and the covered software is not incompatible with secondary "
        "licenses this license permits you to additionally distribute such covered software under the terms of such "
        "secondary license s so that the recipient of the larger work may at their option further distribute the "
        "covered software under the terms of either this license or such secondary license s 3 4 notices you may not "
        "remove or alter the substance of any license notices including copyright notices patent notices disclaimers of "
        "warranty or limitations of liability contained within the source code form of the covered software except that "
        "you may alter any license notices to the extent required to remedy known factual inaccuracies 3 5 application "
        "of additional terms you may choose to offer and to charge a fee for warranty support indemnity or liability "
        "obligations to one or more recipients of covered software however you may do so only on your own behalf and "
        "not on behalf of any contributor you must make it absolutely clear that any such warranty support indemnity or "
        "liability obligation is offered by you alone and you hereby agree to indemnify every contributor for any "
        "liability incurred by such contributor as a result of warranty support indemnity or liability terms you offer "
        "you may include additional disclaimers of warranty and limitations of liability specific to any jurisdiction 4 "
        "inability to comply due to statute or regulation if it is impossible for you to comply with any of the terms "
        "of this license with respect to some or all of the covered software due to statute judicial order or "
        "regulation then you must a comply with the terms of this license to the maximum extent possible and b describe "
        "the limitations and the code they affect such description must be placed in a text file included with all "
        "distributions of the covered software under this license except to the extent prohibited by statute or "
        "regulation such description must be sufficiently detailed for a recipient of ordinary skill to be able to "
        "understand it 5 termination 5 1 the rights granted under this license will terminate automatically if you fail "
        "to comply with any of its terms however if you become compliant then the rights granted under this license "
        "from a particular contributor are reinstated a provisionally unless and until such contributor explicitly and "
        "finally terminates your grants and b on an ongoing basis if such contributor fails to notify you of the non "
        "compliance by some reasonable means prior to 60 days after you have come back into compliance moreover your "
        "grants from a particular contributor are reinstated on an ongoing basis if such contributor notifies you of "
        "the non compliance by some reasonable means this is the first time you have received notice of non compliance "
        "with this license from such contributor and you become compliant prior to 30 days after your receipt of the "
        "notice 5 2 if you initiate litigation against any entity by asserting a patent infringement claim excluding "
        "declaratory judgment actions counter claims and cross claims alleging that a contributor version directly or "
        "indirectly infringes any patent then the rights granted to you by any and all contributors for the covered "
        "software under section 2 1 of this license shall terminate 5 3 in the event of termination under sections 5 1 "
        "or 5 2 above all end user license agreements excluding distributors and resellers which have been validly "
        "granted by you or your distributors under this license prior to termination shall survive termination 6 "
        "disclaimer of warranty covered software is provided under this license on an as is basis without warranty of "
        "any kind either expressed implied or statutory including without limitation warranties that the covered "
        "software is free of defects merchantable fit for a particular purpose or non infringing the entire risk as to "
        "the quality and performance of the covered software is with you should any covered software prove defective in "
        "any respect you not any contributor assume the cost of any necessary servicing repair or correction this "
        "disclaimer of warranty constitutes an essential part of this license no use of any covered software is "
        "authorized under this license except under this disclaimer 7 limitation of liability under no circumstances "
        "and under no legal theory whether tort including negligence contract or otherwise shall any contributor or "
        "anyone who distributes covered software as permitted above be liable to you for any direct indirect special "
        "incidental or consequential damages of any character including without limitation damages for lost profits "
        "loss of goodwill work stoppage computer failure or malfunction or any and all other commercial damages or "
        "losses even if such party shall have been informed of the possibility of such damages this limitation of "
        "liability shall not apply to liability for death or personal injury resulting from such party s negligence to "
        "the extent applicable law prohibits such limitation some jurisdictions do not allow the exclusion or "
        "limitation of incidental or consequential damages so this exclusion and limitation may not apply to you 8 "
        "litigation any litigation relating to this license may be brought only in the courts of a jurisdiction where "
        "the defendant maintains its principal place of business and such litigation shall be governed by laws of that "
        "jurisdiction without reference to its conflict of law provisions nothing in this section shall prevent a party "
        "s ability to bring cross claims or counter claims 9 miscellaneous this license represents the complete "
        "agreement concerning the subject matter hereof if any provision of this license is held to be unenforceable "
        "such provision shall be reformed only to the extent necessary to make it enforceable any law or regulation "
        "which provides that the language of a contract shall be construed against the drafter shall not be used to "
        "construe this license against a contributor 10 versions of the license 10 1 new versions mozilla foundation is "
        "the license steward except as provided in section 10 3 no one other than the license steward has the right to "
        "modify or publish new versions of this license each version will be given a distinguishing version number 10 2 "
        "effect of new versions you may distribute the covered software under the terms of the version of the license "
        "under which you originally received the covered software or under the terms of any subsequent version "
        "published by the license steward 10 3 modified versions if you create software not governed by this license "
        "and you want to create a new license for such software you may create and use a modified version of this "
        "license if you rename the license and remove any references to the name of the license steward except to note "
        "that such modified license differs from this license 10 4 distributing source code form that is incompatible "
        "with secondary licenses if you choose to distribute source code form that is incompatible with secondary "
        "licenses under the terms of this version of the license the notice described in exhibit b of this license must "
        "be attached exhibit a source code form license notice this source code form is subject to the terms of the "
        "mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at "
        "http mozilla org mpl 2 0 if it is not possible or desirable to put the notice in a particular file then you "
        "may include the notice in a location such as a license file in a relevant directory where a recipient would be "
        "likely to look for such a notice you may add additional accurate notices of copyright ownership exhibit b "
        "incompatible with secondary licenses notice this source code form is incompatible with secondary licenses as "
        "defined by the mozilla public license v 2 0 "
    ),
}
